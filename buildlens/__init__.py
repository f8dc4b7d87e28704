"""buildlens: a PySpark warehouse for CI test results and code coverage."""

TOOL_NAME = "buildlens"
