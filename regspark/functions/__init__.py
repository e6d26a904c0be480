from regspark.functions import scalars, textmatch

__all__ = ["scalars", "textmatch"]
