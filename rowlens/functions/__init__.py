"""Column expressions: canonical values, displayed values, predicates and masks."""
