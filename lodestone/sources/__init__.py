"""What is read and written."""
