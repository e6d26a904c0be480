from regspark.streaming import streams

__all__ = ["streams"]
