"""Reading and writing of catalogue files."""
