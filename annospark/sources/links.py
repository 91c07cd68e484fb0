"""Viewer links and states."""

from __future__ import annotations

import json
import re
from urllib.parse import quote, unquote
from urllib.request import urlopen

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = "https://storage.googleapis.com/"


def state_url(address: str) -> str:
    """Where the JSON of a state can be fetched."""
    if address.startswith("gs://"):
        return BUCKETS + address[5:]
    if address.startswith("http") and (n := address.count("://")) in (1, 2):
        return address if n == 1 else BUCKETS + address.split("://")[2]
    raise ValueError(f"not a state address: {address}")


def fetch_state(address: str) -> dict:
    with urlopen(state_url(address), timeout=10) as r:
        return json.load(r)


def parse_link(link: str) -> dict:
    """The state in a link, or the one it names."""
    rest = link.split("#!")
    if len(rest) != 2:
        raise ValueError("a link has one #!")
    return fetch_state(rest[1]) if rest[1].endswith(".json") else json.loads(unquote(rest[1]))


def encode_link(server: str, state: dict) -> str:
    return f"{server}/#!{quote(json.dumps(state))}"


def layers(state: dict) -> dict[str, dict]:
    return {x["name"]: x for x in state["layers"]}


def layer(state: dict, pattern: str) -> dict:
    """The one layer whose name starts with a match of the pattern."""
    found = [x for x in state["layers"] if re.match(pattern, x["name"])]
    if len(found) != 1:
        raise ValueError(f"{len(found)} layers match {pattern!r}, of {[x['name'] for x in state['layers']]}")
    return found[0]


# ---- the same in columns, for any number of states


def encoded(server: str, state: Column) -> Column:
    """Links of states; null for a null state."""
    text = F.url_encode(state)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):  # as a quoted path, not as a form
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"{server}/#!"), text)


def decoded(link: Column) -> Column:
    """States in links; a link without one #! fails."""
    parts = F.split(link, "#!")
    text = F.url_decode(F.replace(parts[1], F.lit("+"), F.lit("%2B")))
    return F.when(link.isNull(), F.lit(None).cast("string")).when(F.size(parts) == 2, text).otherwise(F.raise_error(F.lit("a link has one #!")).cast("string"))


def layer_array(state: Column) -> Column:
    """Type and name of a state's layers, in order."""
    return F.from_json(state, "layers array<struct<type:string,name:string>>")["layers"]


def one_layer(state: Column, pattern: str) -> Column:
    """Type and name of the one layer whose name starts with a match of the pattern; more or none fail; null for a null state."""
    kind = "struct<type:string,name:string>"
    found = F.coalesce(F.filter(layer_array(state), lambda x: x["name"].rlike(f"^(?:{pattern})")), F.array().cast(f"array<{kind}>"))
    wrong = F.raise_error(F.concat(F.size(found).cast("string"), F.lit(" layers match"))).cast(kind)
    return F.when(state.isNull(), F.lit(None).cast(kind)).when(F.size(found) == 1, found[0]).otherwise(wrong)
