"""cuesheet: analytics over timed, tagged items, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
