"""What kind of change turned one string into another, as native column expressions."""
