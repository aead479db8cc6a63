"""skyvane: direction-finding and signal-observation analytics as Spark DataFrame operators."""
