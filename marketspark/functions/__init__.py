"""Column expressions: window helpers, indicators, candle flags, sessions."""
