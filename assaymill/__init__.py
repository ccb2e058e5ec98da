"""assaymill: a PySpark-native engine for harmonising, splitting, auditing and scoring entity-response tables."""
