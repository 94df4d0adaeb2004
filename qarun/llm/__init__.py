"""Operators that prepare documents and pages for language-model training."""
