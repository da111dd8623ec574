"""panelkit: panel-survey analytics as Spark DataFrame transformations."""
