"""Column functions on URLs: hints, parameters, origins. Hosts never match a hint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter names that select an account or bound a range; the first list that matches counts.
ACCOUNT_PARAM_WORDS = ("cuenta", "account", "producto")
FROM_PARAM_NAME, FROM_PARAM_WORDS = "from", ("desde", "inicial", "inicio", "startdate")
TO_PARAM_NAME, TO_PARAM_WORDS = "to", ("hasta", "final", "enddate")
TO_PARAM_BOTH = ("fecha", "fin")

_PARTS = r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?\z"


def any_includes(text: Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any of ``needles``."""
    low = F.lower(text)
    return F.greatest(*(F.contains(low, F.lit(n)) for n in needles), F.lit(False))


def path_query(url: Column) -> Column:
    """Path and query, without the fragment; the whole text if it can't be parsed."""
    return F.coalesce(F.try_parse_url(url, F.lit("FILE")), url)


def url_matches(url: Column, hints: Sequence[str]) -> Column:
    return any_includes(path_query(url), hints)


def same_origin(url: Column, origin: str) -> Column:
    """A prefix test: ``https://h.co`` also accepts ``https://h.co.other``."""
    return F.startswith(url, F.lit(origin))


def is_auth_rejection(status: Column, final_url: Column) -> Column:
    """Status 401 or 403, or a path with a segment ``login``; a query never counts."""
    path = F.coalesce(F.try_parse_url(final_url, F.lit("PATH")), final_url)
    return F.coalesce(status.isin(401, 403), F.lit(False)) | F.coalesce(path.rlike(r"(?i)/login(/|\z)"), F.lit(False))


def component(text: Column) -> Column:
    """Percent-encoding of a path segment: %20 for a space, and ``!'()~`` as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign in "!'()~":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def query_text(params: dict[str, Column]) -> Column:
    """``name=value`` pairs as form data, with ``+`` for a space; null values are left out."""
    return F.concat_ws("&", *(F.concat(F.url_encode(F.lit(n)), F.lit("="), F.url_encode(v)) for n, v in params.items()))


def has_bearer(header: Column) -> Column:
    """Whether an authorization header begins as a bearer token's does; a null one doesn't."""
    return F.coalesce(F.startswith(header, F.lit("Bearer ")), F.lit(False))


def _params(query: Column) -> Column:
    """Decoded ``name, value`` of each parameter, in order; those without any text are left out."""
    one = lambda p: F.struct(
        F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("name"),
        F.when(F.contains(p, F.lit("=")), F.coalesce(F.try_url_decode(F.substr(p, F.instr(p, "=") + 1)), F.substr(p, F.instr(p, "=") + 1))).otherwise(F.lit("")).alias("value"),
    )
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), one)


def _joined(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")


def _rebuilt(url: Column, query: Column) -> Column:
    path = F.regexp_extract(url, _PARTS, 2)
    return F.concat(
        F.regexp_extract(url, _PARTS, 1), F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.regexp_extract(url, _PARTS, 4),
    )


def _first_of_each(params: Column, chosen: Callable[[Column], Column]) -> Column:
    """Without the later ones of those chosen parameters that share a name."""
    numbered = F.transform(params, lambda p, i: F.struct(p["name"].alias("name"), p["value"].alias("value"), i.alias("i")))
    return F.filter(numbered, lambda p: ~chosen(p["name"]) | ~F.exists(numbered, lambda q: (q["name"] == p["name"]) & (q["i"] < p["i"])))


def with_query_param(url: Column, name: str, value: Column | str) -> Column:
    """Set a parameter: the first of that name gets the value and others go, or it is added at the end.

    What has no scheme and host gets the parameter appended as it stands.
    """
    value = F.lit(value) if isinstance(value, str) else value
    params = _params(F.regexp_extract(url, _PARTS, 3))
    mine = lambda n: n == name
    kept = _first_of_each(params, mine)
    plain = F.transform(kept, lambda p: F.struct(p["name"].alias("name"), F.when(mine(p["name"]), value).otherwise(p["value"]).alias("value")))
    extra = F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    every = F.when(F.exists(params, lambda p: mine(p["name"])), plain).otherwise(F.concat(plain, extra))
    naive = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), component(F.lit(name)), F.lit("="), component(value))
    return F.when(url.rlike(_PARTS), _rebuilt(url, _joined(every))).otherwise(naive)


def param_role(name: Column) -> Column:
    """``account``, ``from``, ``to`` or null: what a parameter of this name selects."""
    low = F.lower(name)
    has = lambda words: F.greatest(*(F.contains(low, F.lit(w)) for w in words), F.lit(False))
    both = F.contains(low, F.lit(TO_PARAM_BOTH[0])) & F.contains(low, F.lit(TO_PARAM_BOTH[1]))
    return F.when(has(ACCOUNT_PARAM_WORDS), "account").when((low == FROM_PARAM_NAME) | has(FROM_PARAM_WORDS), "from").when((low == TO_PARAM_NAME) | has(TO_PARAM_WORDS) | both, "to")


def rescope(url: Column, account: str, start: str, end: str) -> Column:
    """Overwrite the parameters that select an account or bound a range, and leave the rest of the URL."""
    params = _params(F.regexp_extract(url, _PARTS, 3))
    known = lambda n: param_role(n).isNotNull()

    def value(p: Column) -> Column:
        role = param_role(p["name"])
        return F.when(role == "account", account).when(role == "from", start).when(role == "to", end).otherwise(p["value"])

    changed = F.transform(_first_of_each(params, known), lambda p: F.struct(p["name"].alias("name"), value(p).alias("value")))
    hit = F.exists(params, lambda p: known(p["name"]))
    return F.when(~url.rlike(_PARTS), url).when(hit, _rebuilt(url, _joined(changed))).otherwise(_rebuilt(url, F.regexp_extract(url, _PARTS, 3)))
