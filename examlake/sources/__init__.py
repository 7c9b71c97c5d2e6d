"""Reading raw year files and lake datasets, and writing them."""
