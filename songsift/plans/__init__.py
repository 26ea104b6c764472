"""The catalogue questions, put together from the operators."""
