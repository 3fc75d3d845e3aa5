"""Candle analytics on Spark: plan, scan, validate, stitch, store and export OHLCV history."""

__version__ = "0.1.0"


def version() -> str:
    return __version__


def codec_version() -> int:
    """Version of the second tier's layout; files of another version are built again."""
    from tallow.sources.sinks import CODEC_VERSION

    return CODEC_VERSION
