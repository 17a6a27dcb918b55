"""civicflow: service-request analytics expressed as Spark DataFrame / SQL plans."""

__version__ = "0.1.0"
