"""Scalar column functions: names, categories, timestamps, sizes, digests.

Everything is a native column expression, so it stays inside whole-stage
code generation and can be pushed next to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the size classes, 10^(1.25*i) cut to whole
# bytes, closed by the largest 64-bit integer.
SIZE_BOUNDS = (
    1, 17, 316, 5623, 100000, 1778279, 31622776, 562341325, 10000000000,
    9223372036854775807,
)

# Ordered substring rules for the kind of secret.
ORIGIN_RULES = (
    ("Private Keys", ("private", "rsa", "ecdsa", "ed25519", "ssh", "private_key",
                      "pgp", "gpg", "pem", "pkey")),
    ("Tokens", ("token", "oauth", "bearer", "github", "gitlab", "gh_token")),
    ("Cloud/API Keys", ("aws", "s3", "access_key", "secret_key", "gcp", "google",
                        "azure", "cloud", "firebase", "twilio", "stripe", "slack",
                        "sendgrid")),
    ("Credentials", ("password", "passwd", "cred", "credential", "db_", "mysql",
                     "postgres", "mongo")),
)

LIBRARY = "library/"
_SHA256 = "sha256:"


def norm_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def expand_aliases(c: Column) -> Column:
    """Name and its official-image alias, as an array of one or two names."""
    n = norm_name(c)
    return (
        F.when(F.startswith(n, F.lit(LIBRARY)),
               F.array(n, F.substr(n, F.lit(len(LIBRARY) + 1))))
        .when(~F.contains(n, F.lit("/")), F.array(n, F.concat(F.lit(LIBRARY), n)))
        .otherwise(F.array(n))
    )


def aliased_by(c: Column) -> Column:
    """The normalised names whose alias is ``c``: the reverse direction of
    ``expand_aliases``, so that a lookup by name or alias is one join."""
    rest = F.substr(c, F.lit(len(LIBRARY) + 1))
    short = F.startswith(c, F.lit(LIBRARY)) & ~F.contains(rest, F.lit("/"))
    longer = F.concat(F.lit(LIBRARY), c)
    return F.when(short, F.array(longer, rest)).otherwise(F.array(longer))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def blank_to_unknown(c: Column, trim: bool = True) -> Column:
    text = F.trim(c) if trim else c
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


_TIME_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
)


def parse_ts(c: Column) -> Column:
    """RFC 3339 (or blank instead of ``T``) with a mandatory offset, else null."""
    s = F.trim(c)
    dotted = F.regexp_replace(s, ",", ".")
    return F.when(s.rlike(_TIME_SHAPE), F.try_to_timestamp(dotted))


def month_key(c: Column) -> Column:
    """``YYYY-MM``; the session time zone is UTC throughout the library."""
    return F.date_format(c, "yyyy-MM")


def epoch_seconds(c: Column, whole: bool = True) -> Column:
    micros = F.unix_micros(c.cast("timestamp"))
    if whole:
        return F.floor(micros / F.lit(1000000)).cast("long")
    return micros / F.lit(1000000.0)


def valid_digest(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def pack_digest(c: Column) -> Column:
    """A text as bytes, a digest in 33 instead of 71: a leading byte tells whether
    the bytes of a digest follow or those of any other text. Equal texts, and only
    these, are equal bytes; the order of texts is not kept."""
    shaped = F.startswith(c, F.lit(_SHA256)) & (F.octet_length(c) == len(_SHA256) + 64) & (c == F.lower(c))
    digits = F.unhex(F.when(shaped, F.substr(c, F.lit(len(_SHA256) + 1))))  # null if one is no digit
    return F.coalesce(F.concat(F.lit(b"\x01"), digits), F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpack_digest(c: Column) -> Column:
    """The text ``pack_digest`` made these bytes from."""
    rest = F.substr(c, F.lit(2))
    return F.when(F.substr(c, F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.concat(F.lit(_SHA256), F.lower(F.hex(rest)))
                  ).otherwise(rest.cast("string"))


def platform_filter(df: DataFrame, images: str, arch: str = "amd64",
                    os: str = "linux") -> DataFrame:
    """One row per image of the wanted platform."""
    wanted = F.filter(
        F.col(images),
        lambda i: (i["architecture"] == F.lit(arch)) & (i["os"] == F.lit(os)),
    )
    kept = [c for c in df.columns if c != images]
    return df.select(*kept, F.explode(wanted).alias("image")).select(*kept, "image.*")


def positive_size(c: Column) -> Column:
    """JSON number to positive bytes; fractions round half away from zero."""
    s = c.cast("string")
    whole = F.when(s.rlike("^-?[0-9]+$"), s.try_cast("long"))
    real = F.when(whole.isNull(), s.try_cast("double"))
    return (
        F.when(whole > 0, whole)
        .when(real > 0, F.round(real).try_cast("long"))
    )


def log_bucket(c: Column, bounds: Sequence[int] = SIZE_BOUNDS) -> Column:
    """Index of the first bound not below the size (last one if none)."""
    out = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        out = F.when(c <= F.lit(bounds[i]), F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out)


def path_depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) + 1


def file_ext(c: Column) -> Column:
    return F.regexp_extract(c, r"([.][^./]*)$", 1)


def official_cat(c: Column, yes: str = "official", no: str = "unofficial") -> Column:
    return F.when(c, F.lit(yes)).otherwise(F.lit(no))


def origin_category(c: Column, rules=ORIGIN_RULES) -> Column:
    low = F.lower(c)
    out = F
    for label, words in rules:
        hit = low.rlike("|".join(words))
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit("Other"))


def combined_weight(*weights: Column, cap: float = 100.0) -> Column:
    product = weights[0]
    for w in weights[1:]:
        product = product * w
    infinite = F.abs(product) == F.lit(float("inf"))
    sane = F.when(product.isNull() | F.isnan(product) | infinite, F.lit(1.0)).otherwise(product)
    return F.least(F.greatest(sane, F.lit(0.0)), F.lit(cap))


def split_owner_name(c: Column) -> Column:
    parts = F.split(F.lower(c), "/")
    return F.struct(
        F.element_at(parts, 1).alias("owner"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("name"),
    )


def log1p_scale(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def repo_digest_project(df: DataFrame, repo: str = "repo_name",
                        digest: str = "digest") -> DataFrame:
    return df.select(F.col(repo).alias("repo"), F.col(digest).alias("digest"))


def drop_sentinel(df: DataFrame, name: str = "repo_name", marker: str = "#/#") -> DataFrame:
    return df.filter(F.col(name).isNull() | (F.col(name) != F.lit(marker)))


def date_range_filter(df: DataFrame, c: str, lo: str = "2016-01-01",
                      hi: str = "2026-01-01") -> DataFrame:
    """Keep months in ``[lo, hi)``; a month is ``YYYY-MM`` or any date text."""
    text = F.col(c).cast("string")
    day = F.coalesce(
        F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"),
        text.try_cast("date"),
    )
    return df.filter((day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date")))


def hash_hex(seed: str | int, *keys: Column) -> Column:
    """Seeded md5 of a key: the reproducible stand-in for a random number."""
    text = [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *text))
