"""Scalar text functions as Column expressions: identities, URLs, titles, times and redaction.  Nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track a reader.
TRACKING_KEYS = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Lower-case characters whose case folding differs from themselves.
FOLDED = (("ß", "ss"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ẖ", "ẖ"), ("ẗ", "ẗ"), ("ẘ", "ẘ"), ("ẙ", "ẙ"), ("ẚ", "aʾ"))
#: Prefixes of references to stored payloads, and marks of secrets in references.
REFERENCE_PREFIXES = ("capture://", "internal://", "local-ref://")
SECRET_MARKS = ("api_key", "apikey", "authorization", "bearer", "cookie", "password", "secret", "token")


def stable_hash(value: Column) -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex."""
    return F.sha2(value.cast("binary"), 256)


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def casefold(value: Column) -> Column:
    out = F.lower(value)
    for a, b in FOLDED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def title_fingerprint(title: Column) -> Column:
    """Hash of the runs of a-z and 0-9 in the folded title, joined by spaces; null if it has none."""
    tokens = F.regexp_extract_all(casefold(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.when(F.size(tokens) > 0, stable_hash(F.array_join(tokens, " ")))


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """One spelling for addresses of the same page, null for anything but http and https with a host and a valid port.

    Scheme and host in lower case, no user, default port, fragment, trailing slashes or tracking keys; query sorted by key
    and value and encoded anew.
    """
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = port.try_cast("int")
    bad_port = (port != "") & (~port.rlike(r"^[0-9]+$") | F.coalesce(number > 65535, F.lit(True)))
    plain = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), _decoded(F.regexp_replace(x, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    netloc = F.when(plain, host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    out = F.concat(scheme, F.lit("://"), netloc, F.when(path == "", F.lit("/")).otherwise(path), F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~bad_port, out)


def squeeze(value: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def has_secret_mark(value: Column) -> Column:
    low = F.lower(value)
    out = F.lit(False)
    for mark in SECRET_MARKS:
        out = out | F.contains(low, F.lit(mark))
    return F.coalesce(out, F.lit(False))


def safe_identifier(value: Column, longest: int) -> Column:
    """The trimmed text if it has 1 to ``longest`` characters and no secret mark, else null."""
    t = F.trim(value)
    return F.when((t != "") & (F.char_length(t) <= longest) & ~has_secret_mark(t), t)


def redact(value: Column, limit: int = 500) -> Column:
    """Named secrets and addresses replaced, then cut to ``limit`` characters."""
    return F.left(F.regexp_replace(value, r"(?i)(authorization|cookie|token|secret|password|cursor)\s*[:=]\s*\S+|https?://\S+", "[REDACTED]"), F.lit(limit))


def instant(value: Column) -> Column:
    """A time from ISO text: ``Z`` and offsets count, a month stands for its first day, no zone is UTC, else null."""
    t = F.trim(value)
    full = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).otherwise(t)
    shaped = full.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(shaped, F.replace(full, F.lit(","), F.lit(".")).try_cast("timestamp"))


def instant_of_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value)


def instant_of_json(value: Column) -> Column:
    """A time from a JSON value (VARIANT): numbers are seconds since 1970, strings as in ``instant``, all else is none."""
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    bounded = F.when(number.between(-62_135_596_800, 253_402_300_799), F.timestamp_seconds(number))
    return F.coalesce(bounded, F.when(kind == "STRING", instant(F.try_variant_get(value, "$", "string"))))


def first_instant(*values: Column) -> Column:
    return F.coalesce(*(instant(v) for v in values))


def canonical_json(value: Column) -> Column:
    """JSON text with sorted keys and no spaces; our pinned form prints numbers as VARIANT does."""
    return F.to_json(F.try_parse_json(value))


def json_string(value: Column) -> Column:
    """A text as JSON in ASCII: all but space to ``~`` is escaped, beyond the first plane as two escapes."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {34: '\\"', 92: "\\\\", 8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(n > 0xFFFF, F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000) % 1024)))
        for code, said in short.items():
            out = out.when(n == code, said)
        return out.when((n < 32) | (n > 126), unit(n)).otherwise(c)

    plain = value.rlike(r'^[ !#-\[\]-~]*$')
    body = F.when(plain, value).otherwise(F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), escaped), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_list(*parts: Column) -> Column:
    """JSON texts as one JSON list, null if one is missing."""
    return F.concat(F.lit("["), *(x for i, p in enumerate(parts) for x in ([F.lit(",")] if i else []) + [p]), F.lit("]"))


def opaque_json(namespace: str, value: Column) -> Column:
    """``namespace:hash`` of a JSON text."""
    return F.concat(F.lit(namespace + ":"), stable_hash(value))


def opaque_ref(namespace: str, value: Column) -> Column:
    """``namespace:hash`` of a string's JSON text, quotes included."""
    return opaque_json(namespace, json_string(value))


def opaque_refs(namespace: str, values: Column) -> Column:
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), present), lambda v: opaque_ref(namespace, v))


def safe_public_url(value: Column) -> Column:
    """The text if it is an http(s) address of at most 4000 characters, with a host, without user and secrets, else null."""
    ok = value.rlike(r"^(?i)https?://[^/?#@\s]+([/?#]\S*)?$") & ~value.rlike(r"(?i)(api[_-]?key|authorization|token|secret|password)=") & (F.char_length(value) <= 4000)
    return F.when(ok, value)


def unsafe_reference(reference: Column) -> Column:
    """Whether a reference to a stored payload is given and lacks an allowed prefix, or has a secret mark."""
    low = F.lower(reference)
    ok = F.lit(False)
    for p in REFERENCE_PREFIXES:
        ok = ok | low.startswith(p)
    return reference.isNotNull() & (~ok | has_secret_mark(reference))


def cursor(item_id: Column, published_at: Column) -> Column:
    """A cursor: canonical JSON of the item and its time."""
    return F.to_json(F.struct(item_id.alias("provider_item_id"), published_at.alias("published_at")))


def cursor_value(text: Column) -> Column:
    """(published_at, provider_item_id) of a cursor, which compares like the cursor itself; null if it can't be read."""
    got = F.from_json(text, "provider_item_id string, published_at string")
    return F.when(present(got["published_at"]) & present(got["provider_item_id"]), F.struct(got["published_at"].alias("p"), got["provider_item_id"].alias("i")))


def cursor_relation(current: Column, candidate: Column, snapshot: Column) -> Column:
    """advance, unchanged or invalid: a strict source must move on, a snapshot source may repeat its cursor."""
    now, new = cursor_value(current), cursor_value(candidate)
    return (
        F.when(new.isNull(), "invalid").when(current.isNull(), "advance").when(now.isNull() | (new < now), "invalid")
        .when(new == now, F.when(snapshot, "unchanged").otherwise("invalid")).otherwise("advance")
    )
