"""Bucket listings: what archives are published."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.text import archive_period
from tallow.model import Interval, Kind, TallowError
from tallow.sources.http import Policy, Transport, get

MAX_PAGES, PAGE_BYTES = 20, 1 << 20
#: Fixed value: the listing document's root element.
ROOT = "ListBucketResult"


@dataclass(frozen=True)
class Listed:
    key: str
    size: int


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_page(body: bytes) -> tuple[list[Listed], bool, str]:
    """Objects, whether more follow, and the marker of the next page; anything but a listing is an error, not an empty one."""
    if len(body) > PAGE_BYTES:
        raise TallowError("a listing page is too large")
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        raise TallowError(f"a listing is not XML: {e}") from None
    if _local(root.tag) != ROOT:
        raise TallowError(f"a listing has the root {_local(root.tag)!r}")
    top = {_local(e.tag): (e.text or "") for e in root if not len(e)}
    found = []
    for e in root:
        if _local(e.tag) == "Contents":
            own = {_local(x.tag): (x.text or "") for x in e}
            found.append(Listed(own.get("Key", ""), int(own.get("Size") or 0)))
    return found, top.get("IsTruncated", "").strip().lower() == "true", top.get("NextMarker", "")


def list_objects(transport: Transport, prefix: str, start_after: str = "", policy: Policy = Policy(), fetch: Callable = get) -> list[Listed]:
    """All objects under a prefix behind `start_after`, page by page; the marker must move on."""
    out: list[Listed] = []
    marker = start_after
    for _ in range(MAX_PAGES):
        body = fetch(transport, "?" + urlencode({"prefix": prefix, "delimiter": "/", **({"marker": marker} if marker else {})}), policy)
        found, more, after = parse_page(body)
        out += found
        if not more:
            return out
        after = after or (found[-1].key if found else "")
        if after <= marker:
            raise TallowError("a truncated listing does not move on")
        marker = after
    raise TallowError(f"a listing has more than {MAX_PAGES} pages")


def archive_prefix(symbol: str, interval: Interval, kind: Kind, market: str = "spot") -> str:
    return f"data/{market}/{kind.value}/klines/{symbol}/{interval.name}/"


def archive_stem(symbol: str, interval: Interval, kind: Kind, start) -> str:
    return f"{symbol}-{interval.name}-{start.strftime('%Y-%m' if kind is Kind.MONTHLY else '%Y-%m-%d')}"


def published(spark: SparkSession, transport: Transport, symbol: str, interval: Interval, since=None, policy: Policy = Policy(), market: str = "spot") -> DataFrame:
    """agg and period of every published archive; sidecars and foreign names go. `since` starts the listing there."""
    rows = []
    for kind in [Kind.MONTHLY] + [Kind.DAILY] * interval.daily:
        prefix = archive_prefix(symbol, interval, kind, market)
        # just before the wanted period's own key
        seek = prefix + archive_stem(symbol, interval, kind, since) if since is not None else ""
        rows += [(kind.value, o.key.removeprefix(prefix)) for o in list_objects(transport, prefix, seek, policy)]
    names = spark.createDataFrame(rows, "agg string, name string")
    period = archive_period(F.col("name"), F.lit(symbol), F.lit(interval.name))
    # a month's name holds seven characters of date, a day's ten
    wide = F.length("name") == len(f"{symbol}-{interval.name}-.zip") + F.when(F.col("agg") == "monthly", 7).otherwise(10)
    return names.where(wide).select("agg", period.alias("period")).where("period IS NOT NULL").distinct()
