"""PySpark-native analytics for payment-risk data."""
