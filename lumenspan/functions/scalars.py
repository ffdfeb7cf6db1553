"""Scalar functions: routes, masks, severities, health, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variable path segments, HTTP methods.
VARIABLE_SEGMENT = (
    r"^[0-9]+$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9a-fA-F]{8,}$"
    r"|^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/=_-]{16,}$"
)
METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")
#: Token masks in the order in which they are tried.
TOKEN_MASKS = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "<UUID>"),
    (r"^(0[xX][0-9a-fA-F]+|[0-9a-fA-F]{16,})$", "<HEX>"),
    (r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]+)?$", "<IP>"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "<TS>"),
    (r"^[^@]+@[^.]+\..*$", "<EMAIL>"),
    (r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$", "<NUM>"),
)
#: Line masks of the raw path, applied one after another.
LINE_MASKS = (
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TS>"),
    (r"\b1[0-9]{12}\b", "<TS>"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"-?\d+(?:\.\d+)?\b", "<NUM>"),
)
SPACE = r"[ \t\n\r\x0B\f]+"


def scaled_round(x: Column, places: int) -> Column:
    """Rounds the scaled double half away from zero: 2.675 at two places is 2.67 or 2.68 as its double is."""
    return F.round(x * 10**places) / 10**places


def normalize_path(path: Column) -> Column:
    """Variable segments become {id}; query and fragment go; what doesn't start with / stays."""
    bare = F.regexp_replace(path, r"(?s)[?#].*$", "")
    segment = lambda s: F.when(s.rlike(VARIABLE_SEGMENT), "{id}").otherwise(s)
    return F.when(path.startswith("/"), F.array_join(F.transform(F.split(bare, "/", -1), segment), "/")).otherwise(path)


def normalize_span_name(name: Column) -> Column:
    """Only "<METHOD> /path" is normalised; any other name stays."""
    method, path = F.regexp_extract(name, r"(?s)^(\S+) (/.*)$", 1), F.regexp_extract(name, r"(?s)^(\S+) (/.*)$", 2)
    return F.when(F.upper(method).isin(*METHODS), F.concat(method, F.lit(" "), normalize_path(path))).otherwise(name)


def normalize_operation(route: Column, path: Column, span: Column) -> Column:
    """The route if there is one, else the path normalised, else the span's name."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(route), some(normalize_path(path)), normalize_span_name(span))


def parse_method(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "NONE").when(F.upper(text).isin(*METHODS), F.upper(text)).otherwise("OTHER")


def http_class(code: Column) -> Column:
    return F.when(code.between(100, 599), F.floor(code / 100)).otherwise(0).cast("int")


def severity_tier_from_number(n: Column) -> Column:
    return F.when(n.between(1, 24), F.floor((n - 1) / 4) + 1).otherwise(0).cast("int")


def severity_tier(text: Column, number: Column) -> Column:
    """1 trace, 2 debug, 3 info, 4 warn, 5 error, 6 fatal; the number wins; unknown text is info, none is 0."""
    up = F.upper(F.coalesce(text, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [up.contains(w) for w in words])
    by_text = F.when(up == "", 0).when(has("FATAL", "CRIT"), 6).when(has("ERR"), 5).when(has("WARN"), 4).when(has("DEBUG"), 2).when(has("TRACE"), 1).otherwise(3)
    return F.when(number.between(1, 24), severity_tier_from_number(number)).otherwise(by_text).cast("int")


def severity_rank(text: Column) -> Column:
    """Rank for the ingest gate: debug 10, info 20, warn 30, error 40, fatal 50; unknown is info."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("DEBUG"), 10).when(up.contains("INFO"), 20).when(up.contains("WARN"), 30).when(up.contains("ERR"), 40).when(up.contains("FATAL"), 50).otherwise(20)


def is_request(parent: Column, kind: Column) -> Column:
    return (F.coalesce(parent, F.lit("")) == "") | F.coalesce(kind == 2, F.lit(False))


def is_gauge_like(temporality: Column, monotonic: Column) -> Column:
    return (temporality != "delta") & ~monotonic


def mask_token(token: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, mask in TOKEN_MASKS:
        extra = (F.length(token) - F.instr(token, "@") >= 3) if mask == "<EMAIL>" else F.lit(True)
        out = out.when(token.rlike(pattern) & extra, mask)
    return out.otherwise(F.regexp_replace(token, "[0-9]+", "<NUM>"))


def mask_tokens(body: Column, most: int = 128) -> Column:
    """The masked tokens of a line; where anything, be it white space, follows ``most`` of them, <TRUNC> stands last."""
    tokens = F.filter(F.split(body, SPACE, -1), lambda t: t != "")
    cut = F.transform(F.slice(tokens, 1, most), mask_token)
    more = (F.size(tokens) > most) | ((F.size(tokens) == most) & body.rlike(SPACE + "$"))
    return F.when(more, F.array_append(cut, F.lit("<TRUNC>"))).otherwise(cut)


def mask_line(line: Column) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), LINE_MASKS, line)


def token_similarity(template: Column, tokens: Column) -> Column:
    """Share of positions that agree; a wildcard agrees with anything; different lengths agree nowhere."""
    same = F.size(F.filter(F.zip_with(template, tokens, lambda a, b: (a == b) | (a == "<*>")), lambda x: x))
    return F.when(F.size(template) == F.size(tokens), F.when(F.size(tokens) == 0, 1.0).otherwise(same / F.size(tokens))).otherwise(0.0)


def health_score(error_rate: Column, mean_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 5 * error_rate - 0.1 * F.greatest(F.lit(0.0), (mean_ms - 100) / 100)))


def health_score_fallback(error_rate: Column, mean_ms: Column) -> Column:
    late = F.when(mean_ms > 200, (mean_ms - 200) / 2000).otherwise(0.0)
    return scaled_round(F.greatest(F.lit(0.0), 1 - 5 * error_rate - late), 2)


def health_status(score: Column) -> Column:
    return F.when(score >= 0.9, "healthy").when(score >= 0.7, "degraded").otherwise("critical")


def alerts(error_rate: Column, p99_ms: Column) -> Column:
    return F.filter(
        F.array(
            F.when(error_rate > 0.05, F.concat(F.lit("high error rate: "), F.floor(error_rate * 100).cast("string"), F.lit("%"))),
            F.when(p99_ms > 500, F.lit("p99 latency exceeds 500ms")),
        ),
        lambda x: x.isNotNull(),
    )


def error_severity(rate: Column) -> Column:
    return F.when(rate > 0.2, "critical").when(rate > 0.1, "warning").otherwise("info")


def latency_severity(mean_ms: Column) -> Column:
    return F.when(mean_ms > 2000, "critical").when(mean_ms > 1000, "warning").otherwise("info")


def relative_severity(now: Column, before: Column) -> Column:
    ratio = F.when(before > 0, now / before)
    return F.when(before <= 0, "warning").when(ratio >= 4, "critical").when(ratio >= 2, "warning").otherwise("info")


def bucket_midpoint(lower: Column, upper: Column) -> Column:
    return F.when(lower <= 0, upper / 2).otherwise(F.sqrt(lower * upper))


def bucket_error(lower: Column, upper: Column) -> Column:
    return F.when(lower <= 0, 1.0).otherwise(F.sqrt(upper / F.when(lower > 0, lower)) - 1)


def sanitize_tenant(tenant: Column, default: str = "default") -> Column:
    t = F.trim(tenant)
    return F.when((t != "") & (F.octet_length(t) <= 128) & ~t.rlike(r"\p{Cntrl}"), t).otherwise(default)


def cap_identity(name: Column, most: int, other: str = "__other__") -> Column:
    return F.when(F.octet_length(name) > most, other).otherwise(name)


def cooldown_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(p)) for p in parts])


def window_start(ts: Column, seconds: int = 300) -> Column:
    """Start of the epoch-aligned window, also before 1970."""
    return F.timestamp_seconds((F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds).cast("long"))


def resource_slot(attributes: Column, *names: str) -> Column:
    """The first attribute of a JSON object that is present and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(attributes, f"$['{n}']"), F.lit("")) for n in names])


#: Offset basis (as two halves) and the low part of the prime 2**40 + 435 of 64-bit FNV-1a.
FNV_HIGH, FNV_LOW, FNV_PRIME = 0xCBF29CE4, 0x84222325, 435


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the text's UTF-8, as 16 hex digits, in two halves of 32 bits so that nothing overflows."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"))
    octets = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))
    low32 = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def step(state, octet):
        low = state["low"].bitwiseXOR(octet)
        high = F.shiftright(low * FNV_PRIME, 32) + state["high"] * FNV_PRIME + F.shiftleft(low, 8)
        return F.struct(low32(high).alias("high"), low32(low * FNV_PRIME).alias("low"))

    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("high"), F.lit(FNV_LOW).cast("long").alias("low"))
    return F.aggregate(octets, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))


def producer_id(instance: Column, namespace: Column, service: Column, host: Column, workload: Column) -> Column:
    """Hash of the instance id, else of the other four; never all zeros, which stand for an unknown producer."""
    text = lambda c: F.coalesce(c, F.lit(""))
    four = F.concat(F.lit("t\x00"), *[F.concat(text(c), F.lit("\x00")) for c in (namespace, service, host, workload)])
    key = fnv1a(F.when(text(instance) != "", F.concat(F.lit("i\x00"), instance)).otherwise(four))
    return F.when(key == "0" * 16, "0" * 15 + "1").otherwise(key)


#: Microseconds of each unit of a duration.
UNITS = {"ns": 1e-3, "us": 1.0, "µs": 1.0, "μs": 1.0, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9}


def parse_duration(text: Column) -> Column:
    """Microseconds of a duration such as 1h30m or -2.5s; null if malformed."""
    part = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
    numbers, units = (F.regexp_extract_all(text, F.lit(part), F.lit(i)) for i in (1, 2))
    factor = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * factor[u]), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.rlike(rf"^[+-]?({part})+$"), F.when(text.startswith("-"), -total).otherwise(total)).when(text.rlike("^[+-]?0$"), 0.0)


def parse_moment(text: Column) -> Column:
    """An RFC 3339 time; null if malformed."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


def alerts_by_mean(error_rate: Column, mean_ms: Column) -> Column:
    """Alerts of the system graph."""
    return F.filter(
        F.array(
            F.when(error_rate > 0.05, "error rate above 5%"), F.when(error_rate > 0.10, "error rate above 10% — investigate immediately"),
            F.when(mean_ms > 500, "avg latency above 500ms"), F.when(mean_ms > 1000, "avg latency above 1s — SLA breach risk"),
        ),
        lambda x: x.isNotNull(),
    )


def valid_series(signal: Column, status: Column, http_class: Column, method: Column, variant: Column) -> Column:
    """Whether a series key's parts are in range and fit its signal: only traces have a class, method and kind."""
    kinds = ("unspecified", "internal", "server", "client", "producer", "consumer")
    known = http_class.between(0, 5) & method.isin("NONE", "OTHER", *METHODS) & variant.isin(*kinds) & signal.isin("trace", "edge", "log", "metric", "system")
    bare = (http_class == 0) & (method == "NONE") & (variant == "unspecified")
    return F.coalesce(known & status.isNotNull() & ((signal == "trace") | bare), F.lit(False))
