from regspark.plans import importer, study, validation

__all__ = ["importer", "study", "validation"]
