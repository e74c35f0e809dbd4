"""DataFrame operators: parsing, detection, alerting and reporting."""
