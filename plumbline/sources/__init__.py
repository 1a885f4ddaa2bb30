"""Reading messy files as tables of text, and writing tables out."""
