"""Extensions for streams: index upkeep and debounced sessions."""
