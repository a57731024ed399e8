"""Scalar functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings.
VIDEO_ENDINGS = (".mov", ".mp4", ".avi", ".mkv", ".wmv", ".m4v", ".3gp", ".webm", ".mts", ".m2ts")
RAW_ENDINGS = (".dng", ".raw", ".cr2", ".cr3", ".nef", ".arw", ".rw2", ".orf", ".raf", ".sr2", ".srw", ".x3f")

# Words that say nothing of a lens.
STOP_WORDS = "a an the and or but in on at to for of with by from as is was are were be been being it this that these those i you he she we they my your our their".split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Lower case of A to Z only, as a catalog database folds text."""
    return F.translate(x, _UPPER, _LOWER)


def exact_round(x: Column, digits: int) -> Column:
    """``x`` rounded as the binary value that it is, halves to even; exact while ``x * 10^digits`` stays under 2^52.

    The product with the power of ten is taken without error, as a sum of two
    doubles, so what is compared with one half is the value itself and not its
    rounded product or its decimal text.
    """
    scale, split = float(10**digits), 134217729.0
    s1 = scale * split - (scale * split - scale)
    s2 = scale - s1
    x = x.cast("double")
    x1 = x * split - (x * split - x)
    x2 = x - x1
    high = x * scale
    low = ((x1 * s1 - high) + x1 * s2 + x2 * s1) + x2 * s2
    whole = F.floor(high).cast("double")
    over = high - whole - 0.5
    up = (over > 0) | ((over == 0) & ((low > 0) | ((low == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / scale


def image_key(date_taken: Column, filename: Column) -> Column:
    """The first ten characters of the date, ``_``, the file name; ``unknown`` for what is missing."""
    part = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))
    return F.concat(part(F.substring(date_taken, 1, 10)), F.lit("_"), part(filename))


def text_timestamp(x: Column) -> Column:
    """A timestamp from ISO text that starts with a full date, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(x))


def year_month(x: Column) -> Column:
    """yyyyMM of an ISO text."""
    return F.date_format(text_timestamp(x), "yyyyMM")


def year(x: Column) -> Column:
    """yyyy of an ISO text."""
    return F.date_format(text_timestamp(x), "yyyy")


def months_before(day: Column, months: int) -> Column:
    """``day`` less some months, with surplus days running over into the next month."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def like_substring(x: Column, wanted: str) -> Column:
    """``%wanted%`` folding A to Z only; ``%`` and ``_`` inside stay wildcards, a backslash is itself."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in wanted).replace("\\", "\\\\")
    return ascii_lower(x).like(f"%{folded}%")


def json_strings(x: Column) -> Column:
    """A JSON array of strings; null where it is not one."""
    return F.from_json(x, "array<string>")


def json_any_of(x: Column, wanted: list[str]) -> Column:
    """Whether a JSON array holds one of the trimmed, non-blank ``wanted``; true where none is left."""
    terms = [w.strip() for w in wanted if w.strip()]
    if not terms:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(json_strings(x), F.array(*map(F.lit, terms))), F.lit(False))


def non_empty_json_list(x: Column) -> Column:
    """Text that is not null, ``[]``, ``null`` or empty."""
    return x.isNotNull() & ~x.isin("[]", "null", "")


def collapse_space(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def search_document(summary: Column, subjects: Column) -> Column:
    """The text that is searched: summary and those subjects that are strings."""
    # a variant keeps the kind of each member, which array<string> does not
    members = F.try_variant_get(F.try_parse_json(subjects), "$", "array<variant>")
    said = F.filter(members, lambda v: F.schema_of_variant(v) == "STRING")
    joined = F.array_join(F.coalesce(F.transform(said, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>")), " ")
    return collapse_space(F.concat_ws(" ", F.coalesce(summary, F.lit("")), joined))


def preview(x: Column, size: int = 240) -> Column:
    """Trimmed text, cut with an ellipsis where it is longer than ``size``."""
    text = F.trim(x)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…")))


def similarity(distance: Column) -> Column:
    """1 - distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def match_label(sim: Column) -> Column:
    """``Visual match (N%)``."""
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(sim * 100).cast("int")))
    return F.concat(F.lit("Visual match ("), percent.cast("string"), F.lit("%)"))


def gap_seconds(a: Column, b: Column) -> Column:
    """Whole seconds between two timestamps; a missing one counts as the epoch."""
    at = lambda x: F.coalesce(F.unix_timestamp(x), F.lit(0))
    return F.abs(at(a) - at(b))


def optional_marker(markdown: Column) -> Column:
    """Whether a prompt carries the optional marker."""
    return markdown.rlike(r"(?i)<!--\s*optional\s*:\s*true\s*-->")


def display_name(slug: Column) -> Column:
    """Title case of a slug."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def prompt_version(slug: Column, markdown: Column) -> Column:
    """slug:first 16 hex digits of the prompt's SHA-256."""
    return F.concat(slug, F.lit(":"), F.substring(F.sha2(markdown, 256), 1, 16))


def normal_slug(x: Column) -> Column:
    """Lower case, trimmed, without a trailing parenthesis."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")))


def has_ending(path: Column, endings: tuple[str, ...]) -> Column:
    """Whether a path has one of the endings."""
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)).isin(*endings)


def not_video(path: Column) -> Column:
    """Rows whose path is known and not a video's."""
    return path.isNotNull() & ~has_ending(path, VIDEO_ENDINGS)


def repetition_flag(x: Column) -> Column:
    """1 or 0 of a loosely typed flag: true, 1 and the texts 1, true, yes are 1, all else is 0; null stays null."""
    yes = F.when(F.typeof(x) == "string", x.cast("string").isin("1", "true", "yes")).otherwise(x.try_cast("double") == 1)
    return F.when(x.isNotNull(), F.coalesce(yes, F.lit(False)).cast("int"))


def typed_score(x: Column) -> Column:
    """A score from 1 to 10 of a variant: a whole number, or text of digits; a boolean is none."""
    kind = F.schema_of_variant(x)
    number = F.try_variant_get(x, "$", "double")
    text = F.trim(F.try_variant_get(x, "$", "string"))
    digits = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    whole = F.when(kind == "STRING", digits).when(kind != "BOOLEAN", F.when(number == F.floor(number), number.try_cast("bigint")))
    return F.when(whole.between(1, 10), whole)


def rationale_tokens(x: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of three letters or more in lower case, without stop words."""
    words = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda w: F.trim(w, F.lit("'")))
    kept = F.filter(words, lambda w: F.length(w) >= 3)
    return F.filter(kept, lambda w: ~w.isin(*stop_words)) if stop_words else kept


def log_odds(count: Column, tokens: Column, corpus_count: Column, corpus_tokens: Column) -> Column:
    """ln of a word's rate in a group over its rate in the corpus."""
    return F.log((count / tokens) / (F.greatest(corpus_count, F.lit(0.5)) / corpus_tokens))


def z_score(votes: Column, expected: Column, population: Column) -> Column:
    """Votes against a binomial expectation; 0 where it has no spread."""
    share = expected / population
    spread = population * share * (1 - share)
    return F.when(spread > 0, (votes - expected) / F.sqrt(spread)).otherwise(F.lit(0.0))


# Labels of a signature section.
LEADING, DEFINING, CLEAR, STRENGTH = "Leading, but not strongly distinctive", "A defining strength", "A clear strength", "A strength"


def strength(crowned: Column, z: Column, fallback: Column | None = None) -> Column:
    """Label of a lens; ``fallback`` says that it leads only because none is crowned."""
    label = F.when(z >= 6, DEFINING).when(z >= 3, CLEAR).when(crowned, STRENGTH).otherwise(LEADING)
    return label if fallback is None else F.when(fallback, LEADING).otherwise(label)


def search_terms(query: str | None) -> list[str] | None:
    """Terms of a full-text query: runs of ASCII letters and digits of two or more.

    None means no filter (blank, or punctuation only); a query shorter than two
    characters is an error.
    """
    text = (query or "").strip()
    if not text:
        return None
    if len(text) < 2:
        raise ValueError("a search needs two characters or more")
    return [t for t in re.findall(r"[A-Za-z0-9]+", text) if len(t) >= 2] or None


def page_bounds(limit: int | None, offset: int | None, most: int = 500, usual: int = 50) -> tuple[int, int]:
    """Limit from 1 to ``most``, offset from 0."""
    return max(1, min(most, usual if limit is None else limit)), max(0, offset or 0)


def page_envelope(total: int, limit: int, offset: int) -> dict:
    """has_more, current_page, total_pages."""
    return {"total": total, "has_more": offset + limit < total, "current_page": offset // limit + 1, "total_pages": -(-total // limit)}


def visual_attributes(colors: Column, moods: Column, technical: Column) -> tuple[Column, Column]:
    """Colour and mood lists of a description as JSON text.

    An empty or missing colour list falls back to the technical part's; a mood
    list only where it is missing, to the technical part's one mood.
    """
    listed = lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("ARRAY"), F.to_json(F.try_parse_json(x)))
    mood = F.trim(F.get_json_object(technical, "$.mood"))
    own = listed(colors)
    color = F.when(own != "[]", own).otherwise(listed(F.get_json_object(technical, "$.dominant_colors")))
    return color, F.coalesce(listed(moods), F.when(mood != "", F.to_json(F.array(mood))))


def json_list_or_map(x: Column) -> Column:
    """JSON text that is an array or an object, in one form; anything else is null."""
    value = F.try_parse_json(x)
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))


def source_date(x: Column) -> Column:
    """A source catalog's date: ISO text to the second in one form, other text as it is, empty as null."""
    full = F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"), F.try_to_timestamp(x, F.lit("y-M-d'T'H:m:s")))
    return F.nullif(F.coalesce(F.date_format(full, "yyyy-MM-dd'T'HH:mm:ss"), x), F.lit(""))


def source_number(x: Column) -> Column:
    """A coordinate given as text; null where it is none."""
    return F.trim(x).try_cast("double")


def digits_id(x: Column) -> Column:
    """An id of digits only as a number, else null."""
    text = F.trim(x.cast("string"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def stage_progress(stage: Column, percent: Column, stages: int = 4) -> Column:
    """Progress of a run of equal stages, from 5 to 100, where one stage's own progress runs from 5 to 100."""
    span = (100 - 5) / stages
    share = (F.greatest(F.lit(5), F.least(F.lit(100), percent)) - 5) / F.lit(95.0)
    return F.least(F.lit(100.0), 5 + stage * span + share * span).cast("int")


def range_progress(percent: Column, low: float, high: float) -> Column:
    """Progress from 0 to 100 mapped to a range."""
    return (low + (high - low) * percent / F.lit(100)).cast("int")
