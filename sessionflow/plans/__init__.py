"""Plan-shaping helpers: report rows."""
