"""Reading and writing of articles, run results and guesses."""
