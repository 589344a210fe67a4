"""Scalar text functions as column expressions (all inside the JVM).

Word characters are letters and digits of any script and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

W = r"[\p{L}\p{N}_]"

# Letters and what a full-text index folds them to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Words that are no topics.
STOP_WORDS = (
    "about across after also among analysis approach architecture based because being between called concept concepts could "
    "data details entity from group have idea ideas into itself knowledge layer layered linked many model models note notes "
    "paper page pages project related relation representation research source sources summary system that their them there "
    "these they this through using what when with"
).split()

# Tokens shown in capitals.
ACRONYMS = ("rag", "rlhf", "ppo", "gpt", "bert", "llm", "ml", "nlp", "api", "ui", "ux")


def collapse(c: Column) -> Column:
    """SCA-07: runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """FTS-01: lower-case words without accents."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_key(c: Column) -> Column:
    """SCA-01: the key under which spellings of a name meet."""
    s = F.regexp_replace(F.trim(F.lower(c)), r"[-_/\\.]", " ")
    s = F.regexp_replace(s, r"([a-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([a-z])", "$1 $2")
    return collapse(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", ""))


def name_keys(name: Column, aliases: Column) -> Column:
    """SCA-02: the distinct keys of a name and its aliases that are not blank."""
    return F.array_distinct(F.concat(F.array(name_key(name)), F.transform(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a) != ""), name_key)))


def slugify(c: Column, collapse_dashes: bool = True, size: int | None = 80) -> Column:
    """SCA-03: lower case, only word characters and dashes. The variants for
    questions (dashes stay apart) and projects (no size) are parameters."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(s, r"[\s_]+", "-")
    if collapse_dashes:
        s = F.regexp_replace(s, r"-+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.substring(s, 1, size) if size else s


def url_domain(c: Column) -> Column:
    """SCA-04: the authority of a URL in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(c, r"^[A-Za-z][^:/?#]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")


def trusted(domain: Column, folder: Column, domains: list[str], folders: list[str]) -> Column:
    """SCA-05: the domain ends with a trusted one or the folder holds a trusted name."""
    tests = [(domain != "") & F.endswith(domain, F.lit(d.lower())) for d in domains]
    tests += [F.contains(F.lower(F.coalesce(folder, F.lit(""))), F.lit(f.lower())) for f in folders]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def unix_seconds(c: Column) -> Column:
    """SCA-06: null where not positive or not a number."""
    n = c.cast("string").try_cast("bigint")
    return F.when(n > 0, F.timestamp_seconds(n))


def chrome_micros(c: Column) -> Column:
    """Microseconds since 1601."""
    n = c.cast("string").try_cast("bigint")
    return F.when(n > 0, F.timestamp_micros(n - F.lit(11644473600000000)))


def unix_micros(c: Column) -> Column:
    n = c.cast("string").try_cast("bigint")
    return F.when(n > 0, F.timestamp_micros(n))


def strip_front_matter(c: Column) -> Column:
    """SRC-15: without a leading block between lines of dashes."""
    return F.regexp_replace(c, r"(?s)\A---\s*\n.*?\n---\s*\n?", "")


def repaired(c: Column) -> Column:
    """SCA-08: ligatures taken apart and front matter removed."""
    return strip_front_matter(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")))


def placeholder_title(c: Column) -> Column:
    """SCA-09: no title, a source identifier, a PDF's name or an arXiv number."""
    s = F.lower(F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), "^[\"']+|[\"']+$", ""))
    return (s == "") | F.startswith(s, F.lit("src_")) | F.endswith(s, F.lit(".pdf")) | F.regexp_like(s, F.lit(r"^\d{4}\.\d{5}(v\d+)?(_\d+)?$"))


def key_claims(c: Column, limit: int = 4) -> Column:
    """SCA-13: sentences of 35 characters or more, cut at 240; else the text's start."""
    clean = collapse(c)
    bare = F.transform(F.split(clean, r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^[ \-•]+|[ \-•]+$", ""))
    long_ = F.slice(F.transform(F.filter(bare, lambda x: F.length(x) >= 35), lambda x: F.rtrim(F.substring(x, 1, 240))), 1, limit)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(long_) > 0, long_).otherwise(F.array(F.rtrim(F.substring(clean, 1, 240))))


def topical_terms(c: Column, limit: int = 16) -> Column:
    """SCA-22: distinct terms in order: tokens, and their parts at - and +."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9+-]+"), F.lit(0))
    every = F.flatten(F.transform(found, lambda t: F.when(F.regexp_like(t, F.lit("[-+]")), F.concat(F.array(t), F.filter(F.split(t, "[-+]"), lambda p: p != ""))).otherwise(F.array(t))))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(every, lambda t: ~F.array_contains(stop, t) & ~F.regexp_like(t, F.lit("^[0-9]+$")) & (F.length(t) > 2))
    return F.slice(F.array_distinct(kept), 1, limit)


def display_token(c: Column) -> Column:
    """SCA-23: acronyms and short letters in capitals, others as titles."""
    return F.when(c.isin(*ACRONYMS) | F.regexp_like(c, F.lit("^[a-z]{1,3}$")), F.upper(c)).otherwise(F.initcap(F.replace(c, F.lit("-"), F.lit(" "))))


def name_variants(c: Column) -> Column:
    """SCA-24: the name, its singular, with spaces for dashes, and letters and digits only."""
    raw = F.trim(F.lower(c))
    one = F.when(F.endswith(raw, F.lit("s")) & (F.length(raw) > 4), F.regexp_replace(raw, "s$", "")).otherwise(raw)
    forms = [v for x in (raw, one) for v in (x, F.replace(x, F.lit("-"), F.lit(" ")), F.regexp_replace(x, "[^a-z0-9]+", ""))]
    return F.array_distinct(F.filter(F.transform(F.array(*forms), lambda v: F.trim(v)), lambda v: v != ""))


def mentions(text: Column, variants: Column) -> Column:
    """SCA-25: a variant of several words lies in the text, or a plain one of four
    characters or more in the text's letters and digits."""
    low = F.lower(text)
    compact = F.regexp_replace(low, "[^a-z0-9]+", "")
    return F.exists(variants, lambda v: F.when(F.regexp_like(v, F.lit("[ -]")), F.contains(low, v)).otherwise(F.regexp_like(v, F.lit(r"^[\p{L}\p{N}]{4,}$")) & F.contains(compact, v)))


def wikilinks(c: Column) -> Column:
    """SCA-26: distinct targets of [[Target#section|label]] in lower case."""
    found = F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.trim(x))))


def stable_noise(c: Column) -> Column:
    """SCA-28: a number from -0.5 to 0.5 fixed by the text."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) - 0.5


def token_count(c: Column) -> Column:
    """SCA-29."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def clamp(c: Column) -> Column:
    """SCA-30: into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def query_terms(c: Column, limit: int = 5) -> Column:
    """SCA-33: words of over three characters, then without . , ? ! at the ends."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 3)
    return F.slice(F.transform(words, lambda w: F.regexp_replace(w, "^[.,?!]+|[.,?!]+$", "")), 1, limit)


def answer_title(c: Column) -> Column:
    """SCA-34."""
    return F.regexp_replace(F.substring(c, 1, 80), r"[.? ]+\z", "")


def safe_file_name(c: Column) -> Column:
    """SCA-35."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def pdf_date(c: Column) -> Column:
    """SRC-10: D:YYYYMMDD... as YYYY-MM-DD, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^(D:)?\d{8}")), F.regexp_replace(c, r"^(?:D:)?(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3"))


def json_text(c: Column, path: str, default: str | None = None) -> Column:
    """SCA-31: the text at a path of a JSON column, else the default."""
    found = F.get_json_object(c, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def json_object(c: Column) -> Column:
    """SCA-32: from the first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """SCA-40."""
    return tokens_in * F.lit(3e-6) + tokens_out * F.lit(15e-6)


def markdown_summary(c: Column, limit: int = 180, fallback: str = "") -> Column:
    """SCA-19: the first line of running text, links and code marks unwrapped."""
    lines = F.transform(F.split(strip_front_matter(c), r"\r\n|\r|\n"), lambda x: F.trim(x))
    body = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("- ")) & ~x.isin("---", "***"))
    plain = F.transform(body, lambda x: collapse(F.regexp_replace(F.regexp_replace(x, r"\[\[([^\]]+)\]\]", "$1"), "`([^`]+)`", "$1")))
    first = F.get(F.filter(plain, lambda x: x != ""), F.lit(0))
    cut = F.when(F.length(first) > limit, F.concat(F.rtrim(F.substring(first, 1, limit - 1)), F.lit("…"))).otherwise(first)
    return F.coalesce(cut, F.lit(fallback))


def log_date(c: Column) -> Column:
    """SCA-20."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm"), F.substring(c, 1, 16)))


def index_entry(title: Column, summary: Column, updated: Column) -> Column:
    """SCA-21."""
    return F.concat(F.lit("- [["), title, F.lit("]]"), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(" — "), summary)).otherwise(F.lit("")), F.when(F.coalesce(updated, F.lit("")) != "", F.concat(F.lit(" ("), F.substring(updated, 1, 10), F.lit(")"))).otherwise(F.lit("")))


def html_title(c: Column) -> Column:
    """SRC-08."""
    return F.trim(F.coalesce(F.regexp_extract(c, r"(?i)<title[^>]*>([^<]+)</title>", 1), F.lit("")))


def html_text(c: Column, limit: int | None = 50_000) -> Column:
    """SRC-07, the branch without libraries: tags to spaces, collapsed, cut to ``limit`` unless that is None."""
    text = collapse(F.regexp_replace(c, "<[^>]+>", " "))
    return text if limit is None else F.substring(text, 1, limit)


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    """FLT-12: a value outside the list becomes the default."""
    return F.when(F.lower(F.trim(c)).isin(*allowed), F.lower(F.trim(c))).otherwise(F.lit(default))
