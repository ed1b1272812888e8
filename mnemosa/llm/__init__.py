"""Training-data operators over a corpus of documents; nothing else in the library imports this subpackage."""
