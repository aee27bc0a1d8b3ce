from .tables import deal, load, spread  # noqa: F401
