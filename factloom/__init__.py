"""factloom: a PySpark-native engine for dated, sourced, contradicting evidence."""
