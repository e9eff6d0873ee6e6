"""Reading lines and stored results, writing reports."""
