"""Column functions: ids, text forms, numbers in text, vectors, URLs, scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.params import HOST_TAGS, ID_FORMATS, KNOBS, SUFFIXES, TITLES


def lookup(values: dict, key: Column, default=None) -> Column:
    """values[key] for a small fixed mapping; default or null for other keys."""
    out = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return out if default is None else F.coalesce(out, F.lit(default))


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone, whatever the session's."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def first_hit(text: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# ------------------------------------------------------------------ ids


def make_id(namespace: str, raw: Column) -> Column:
    """namespace:raw where raw has the format of the namespace, else null."""
    return F.when(raw.rlike(ID_FORMATS[namespace]), F.concat(F.lit(namespace + ":"), raw))


def split_id(canonical: Column) -> Column:
    """struct(namespace, raw) of a well-formed canonical id, else null."""
    namespace = F.substring_index(canonical, ":", 1)
    raw = F.regexp_extract(canonical, "^[^:]*:(.*)$", 1)
    valid = F.lit(False)
    for name, form in ID_FORMATS.items():
        valid = valid | ((namespace == name) & raw.rlike(form))
    return F.when(canonical.contains(":") & valid, F.struct(namespace.alias("namespace"), raw.alias("raw")))


def state_key(text: Column) -> Column:
    """Key under which states are looked up: spaces collapsed, lower case, no final dot."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"\.+$", "")


def series_id(text: Column) -> Column:
    key = F.upper(F.trim(text))
    return F.when(key.rlike(ID_FORMATS["fred"]), key)


def bill_id(congress: Column, kind: Column, number: Column) -> Column:
    raw = F.concat_ws("-", congress.cast("string"), F.replace(F.lower(F.trim(kind)), F.lit("."), F.lit("")), F.trim(number.cast("string")))
    return make_id("bill", raw)


def vote_bill_id(congress: Column, number: Column) -> Column:
    """Bill id of a roll call's bill number; nominations and the like give null."""
    form = "^(SCONRES|HCONRES|SJRES|HJRES|SRES|HRES|HR|S)([0-9]{1,5})$"
    key = F.upper(F.trim(number))
    return F.when(key.rlike(form), bill_id(congress, F.regexp_extract(key, form, 1), F.regexp_extract(key, form, 2)))


def bill_label(canonical: Column) -> Column:
    part = F.split(F.substring_index(canonical, ":", -1), "-")
    kind = F.when(part[1] == "s", "S.").when(part[1] == "hr", "H.R.").otherwise(F.upper(part[1]))
    return F.concat(kind, F.lit(" "), part[2], F.lit(" ("), part[0], F.lit("th)"))


# ------------------------------------------------------------------ mentions


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; built-ins have none."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def composed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility composition (NFKC) of each text; of a batch only some texts at a time are Python objects."""
    form = lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)
    for batch in texts:
        yield pa.concat_arrays([pa.array(map(form, batch.slice(at, 64).to_pylist()), pa.string()) for at in range(0, len(batch), 64)] or [pa.array([], pa.string())])


_composed = F.arrow_udf(composed, T.StringType())


def compatible(text: Column) -> Column:
    """Compatibility composition (NFKC).  ASCII texts are composed, so they do not go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def folded_form(folded: Column) -> Column:
    """The plain form of a mention whose accents are folded: lower case words, no title, no suffix."""
    text = F.translate(F.lower(folded), "'’", "")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    text = F.regexp_replace(text, rf"^(?:{TITLES})\b\s*", "")
    return F.regexp_replace(text, rf"\s+(?:{SUFFIXES})$", "")


def mention_forms(mention: Column, fold=fold_accents) -> Column:
    """Distinct non-empty forms, most specific first: as it stands, and without parentheses."""
    raw = F.regexp_replace(F.trim(mention), "^@+", "")
    forms = F.array(folded_form(fold(raw)), folded_form(fold(F.regexp_replace(raw, r"\([^)]*\)", " "))))
    return F.filter(F.array_distinct(forms), lambda f: f.isNotNull() & (f != ""))


# ------------------------------------------------------------------ text


def span_form(text: Column, compose=compatible) -> Column:
    """Text with curly quotes, dashes and white space evened out."""
    plain = F.translate(compose(text), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def grounded_forms(span: Column, text: Column) -> Column:
    """Whether a span stands in a text, three characters at least; both in their span form."""
    return F.coalesce((F.length(span) >= 3) & F.contains(text, span), F.lit(False))


def grounded(span: Column, text: Column, compose=compatible) -> Column:
    """Whether the span stands in the text, three characters at least."""
    return grounded_forms(span_form(span, compose), span_form(text, compose))


def number_set(text: Column) -> Column:
    """Distinct numbers of a text, without thousands commas."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


# ------------------------------------------------------------------ vectors


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 where either is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def unit(v: Column) -> Column:
    """v in doubles, scaled to length 1; a zero vector as it is."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.transform(F.array(norm), lambda n: F.transform(x, lambda e: F.when(n == 0, e).otherwise(e / n))).getItem(0)


def dot(a: Column, b: Column) -> Column:
    """Inner product, which for unit vectors is their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def checked_vector(v: Column, dimension: int) -> Column:
    """v, or an error where its length differs from dimension."""
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size(v).cast("string"))))


# ------------------------------------------------------------------ sources and scores


def independence_key(source_type: Column, url: Column) -> Column:
    """type|host, and for social posts the account, so that copies of one outlet count once."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    account = F.lower(F.element_at(F.split(F.regexp_replace(path, "^/+", ""), "/"), 1))
    origin = F.when((source_type == "social_post") & (account != ""), F.concat_ws("/", host, account)).otherwise(host)
    return F.concat_ws("|", F.coalesce(source_type, F.lit("unknown")), origin)


def source_tag(url: Column) -> Column:
    """Short label of a url's host: that of the host or a domain above it, else the name before the last
    dot in capitals, SRC without one (W13)."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), url, F.lit(""))), r"^www\.", "")
    known = F.coalesce(*[F.when(host.rlike(rf"(^|\.){d.replace('.', '[.]')}$"), F.lit(t)) for d, t in HOST_TAGS.items()])
    name = F.upper(F.try_element_at(F.split(host, r"\."), F.lit(-2)))
    return F.coalesce(known, F.nullif(name, F.lit("")), F.lit("SRC"))


def election_day(cycle: Column) -> Column:
    """Tuesday after the first Monday in November."""
    return F.date_add(F.next_day(F.make_date(cycle, F.lit(10), F.lit(31)), "MON"), 1)


def recency(ts: Column, now: Column, half_life: float = KNOBS.half_life_hours) -> Column:
    age = F.greatest(F.lit(0.0), (epoch_us(now) - epoch_us(ts)) / 3_600_000_000)
    return F.pow(F.lit(0.5), age / half_life)


def election_proximity(confidence: Column, cycle: Column, now: Column, tau: float = KNOBS.election_days) -> Column:
    days = F.datediff(election_day(cycle), now.cast("date"))
    return F.when(days < 0, F.lit(0.0)).otherwise(confidence * F.exp(-days / F.lit(tau)))


def salience(recent: Column, sources: Column, importance: Column, bonus: Column, election: Column, weights=KNOBS.weights) -> Column:
    parts = (recent, F.log(1 + sources.cast("double")), importance, bonus, election)
    out = F.lit(0.0)
    for w, p in zip(weights, parts):
        out = out + F.lit(w) * p
    return out


def stance_side(stance: Column) -> Column:
    """1 for support of any strength, -1 for opposition, 0 else."""
    return F.when(stance.isin("strongly_support", "support", "lean_support"), 1).when(stance.isin("strongly_oppose", "oppose", "lean_oppose"), -1).otherwise(0)


def band(sim: Column, low: float = KNOBS.t_low, high: float = KNOBS.t_high) -> Column:
    """NEW, ATTACH, or TIEBREAK between them."""
    return F.when(sim.isNull() | (sim < low), "NEW").when(sim >= high, "ATTACH").otherwise("TIEBREAK")
