"""Reading and writing: spreadsheets, delimited results and vector tables."""
