"""Front end: text to tree and back."""
