"""Column -> Column text functions, all JVM-side (regexp_replace chains,
higher-order array functions). No Python UDF is used anywhere in this module.

Regex notes (Java regex as used by Spark):
* ``W`` below is ``[\\p{L}\\p{N}_]``: Python's Unicode ``\\w`` (letters, numbers,
  underscore). Java's ``\\w`` is ASCII and ``(?U)\\w`` also takes combining marks.
* ``.`` must cross ``\\r`` and U+2028 where Python's does, hence ``(?s)`` where the
  newline has already been replaced.
* Python ``str.strip()`` also strips U+001C..U+001F, which Java ``\\s`` lacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = "[\\p{L}\\p{N}_]"
# Letters and numbers of a word that are not decimal digits.
NO_DIGIT = "[_\\p{L}\\p{Nl}\\p{No}]"
# What Python's str.strip() takes for white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no argument (Unicode whitespace): only the
    ends are looked at, however many blanks stand between."""
    return F.btrim(_c(c), F.lit(SPACES))


def clean_lyrics(c) -> Column:
    """newline -> space; drop , . ! ?; [..] -> space; words holding a digit ->
    space; ( ) -> space; lower case; strip."""
    x = _c(c)
    for char, by in (("\n", " "), (",", ""), (".", ""), ("!", ""), ("?", ""), ("(", " "), (")", " ")):
        x = F.replace(x, F.lit(char), F.lit(by))
    x = F.regexp_replace(x, "(?s)\\[.*?\\]", " ")
    # Tried at the start of a word only, and without going back in it.
    x = F.regexp_replace(x, f"(?<!{WORD}){NO_DIGIT}*+\\p{{Nd}}{WORD}*+", " ")
    return py_strip(F.lower(x))


def stop_array(stop_words=None) -> Column:
    words = fixed.ENGLISH_STOP_WORDS if stop_words is None else tuple(stop_words)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def remove_stopwords(arr, stop_words=None) -> Column:
    """Drop stop words from a token array, keeping order. The literal list
    becomes a hash-set membership test (OptimizeIn -> InSet)."""
    words = fixed.ENGLISH_STOP_WORDS if stop_words is None else tuple(stop_words)
    if not words:
        return _c(arr)
    return F.filter(_c(arr), lambda t: ~t.isin(*words))


def clean_aggressive(c, stop_words=None) -> Column:
    """lower; punctuation (incl. ``_``) and other non-word chars -> space;
    collapse spaces; non-ASCII runs -> space; drop stop words; re-join."""
    x = F.lower(_c(c).cast("string"))
    x = F.regexp_replace(x, "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]", " ")
    x = F.regexp_replace(x, "(?U)[^\\p{L}\\p{N}_\\s\\x1c-\\x1f]", " ")
    x = F.regexp_replace(x, "(?U)[\\s\\x1c-\\x1f]+", " ")
    x = py_strip(x)
    x = F.regexp_replace(x, "[^\\x00-\\x7F]+", " ")
    toks = F.filter(F.split(x, " "), lambda t: t != "")
    return F.array_join(remove_stopwords(toks, stop_words), " ")


def tokenize_ws(c) -> Column:
    """lower case, split on the whitespace of ``str.split`` (any Unicode
    whitespace and U+001C to U+001F), drop empties; null -> []."""
    return F.filter(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), "(?U)[\\s\\x1c-\\x1f]+"),
                    lambda t: t != "")


def tokenize_word(c) -> Column:
    """Vectoriser default tokens: lower-cased runs of two or more word chars."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({WORD}{{2,}})"), 1)


def ngrams_1_2(arr) -> Column:
    """Unigrams followed by adjacent bigrams (joined by one space)."""
    a = _c(arr)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n),
                         lambda x, y: F.concat(x, F.lit(" "), y))
    return F.concat(a, bigrams)


def thai_digits(c) -> Column:
    return F.translate(_c(c), fixed.THAI_DIGITS, "0123456789")


# Every decimal digit of Unicode in order of its value, by rule, for Python's int().
_ALL_DIGITS = "".join(c for c in map(chr, range(0x110000)) if c.isdecimal() and not c.isascii())
_THEIR_VALUES = "".join(str(int(c)) for c in _ALL_DIGITS)


def ascii_digits(c) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.translate(_c(c), _ALL_DIGITS, _THEIR_VALUES)


def _be_to_ce(raw: Column) -> Column:
    return (ascii_digits(raw).cast("int") - fixed.BUDDHIST_ERA_OFFSET).cast("string")


def _hit(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


# Year rules. (?d): only \n ends a line for '.', as in Python; (?U): Unicode \s.
# Python's \s (str.isspace) = Java (?U)\s plus U+001C..U+001F.
_S = "[\\s\\x1c-\\x1f]"
_SEP = "[·•‧\\-–—|]"
_BE = f"พ\\.?{_S}*ศ\\.?{_S}*([0-9๐-๙]{{4}})"
YEAR_RULE1 = f"(?dU){fixed.YEAR_BY_ARTIST_WORD}{_S}+.+?{_SEP}{_S}*{_BE}"
YEAR_RULE2 = f"(?dU){fixed.YEAR_VIA_WORD}{_S}+[A-Za-zก-๙\\s\\x1c-\\x1f]+?{_S}*{_BE}"
YEAR_RULE4A = f"(?dU)พ\\.ศ\\.?{_S}*(\\p{{Nd}}{{4}})"
YEAR_RULE4B = f"(?dU)\\p{{Nd}}{{1,2}}{_S}*[ก-๙]+{_S}*(\\p{{Nd}}{{4}})"


def extract_year(c, heavy: bool = False) -> Column:
    """Release year from free text by four prioritised rules (see README).
    Rules 1, 2 and 4 convert Buddhist-era years (-543); rule 3 returns the
    first 4-digit run within 20 chars after the first *available* keyword of
    ``release`` (any case), "on sale" (Thai), ``Apple Music`` (any case)."""
    t = _c(c)
    r1 = _hit(t, YEAR_RULE1)
    r2 = _hit(t, YEAR_RULE2)

    def snippet_year(kw_regex: str) -> Column:
        snip = F.regexp_extract(t, f"(?s){kw_regex}(.{{0,{fixed.YEAR_SNIPPET_CHARS}}})", 1)
        return _hit(snip, "(\\p{Nd}{4})")

    k_rel, k_th, k_apple = fixed.YEAR_RELEASE_KEYWORDS
    r3 = (F.when(t.rlike(f"(?iu){k_rel}"), snippet_year(f"(?iu){k_rel}"))
          .when(t.contains(k_th), snippet_year(k_th))
          .when(t.rlike(f"(?iu){k_apple}"), snippet_year(f"(?iu){k_apple}")))
    out = F.coalesce(
        F.when(r1.isNotNull(), _be_to_ce(r1)),
        F.when(r2.isNotNull(), _be_to_ce(r2)),
        r3,
    )
    if heavy:
        r4a = _hit(t, YEAR_RULE4A)
        r4b = _hit(t, YEAR_RULE4B)
        y4b = ascii_digits(r4b).cast("int")
        out = F.coalesce(
            out,
            F.when(r4a.isNotNull(), _be_to_ce(r4a)),
            F.when(y4b >= 2500, (y4b - fixed.BUDDHIST_ERA_OFFSET).cast("string"))
             .when(y4b.isNotNull(), y4b.cast("string")),
        )
    return out


def extract_year_min(c, as_of_year: int) -> Column:
    """Smallest plausible year (1950..as_of_year) among all ``19[5-9]d`` /
    ``20[0-2]d`` substrings; null when none. ``as_of_year`` replaces the
    wall clock so re-runs agree."""
    cands = F.regexp_extract_all(_c(c), F.lit("(19[5-9][0-9๐-๙]|20[0-2][0-9๐-๙])"), 1)
    years = F.transform(cands, lambda y: thai_digits(y).cast("int"))
    ok = F.filter(years, lambda y: (y >= fixed.YEAR_MIN_PLAUSIBLE) & (y <= as_of_year))
    return F.array_min(ok)


def strip_title(full_text, title) -> Column:
    """Remove every occurrence of the title from the text, then strip."""
    ft, ti = _c(full_text), _c(title)
    return py_strip(F.when(F.coalesce(ti, F.lit("")) == "", ft)
                    .otherwise(F.replace(ft, ti, F.lit(""))))


def genre_from_label(label) -> Column:
    """Text after the last ':' of the song-category label, stripped."""
    lb = _c(label)
    return F.when(lb.contains(fixed.GENRE_LABEL_MARKER),
                  py_strip(F.element_at(F.split(lb, ":"), -1)))


def absolute_url(href, base: str | Column) -> Column:
    h = _c(href)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base) if isinstance(base, str) else base, h))


def url_quote(c) -> Column:
    """Python ``urllib.parse.quote`` (safe='/') on top of Java's form encoder."""
    x = F.url_encode(_c(c))
    x = F.replace(x, F.lit("+"), F.lit("%20"))
    x = F.replace(x, F.lit("*"), F.lit("%2A"))
    x = F.replace(x, F.lit("%7E"), F.lit("~"))
    return F.replace(x, F.lit("%2F"), F.lit("/"))


def search_url(base: str, title, artist=None, keyword: str | None = None) -> Column:
    """base + quote("title artist keyword"); artist optional."""
    parts = [_c(title)]
    if artist is not None:
        parts.append(F.when(F.coalesce(_c(artist), F.lit("")) != "", _c(artist)))
    if keyword:
        parts.append(F.lit(keyword))
    return F.concat(F.lit(base), url_quote(F.concat_ws(" ", *parts)))


def epoch_format(c) -> Column:
    """Epoch seconds -> 'yyyy-MM-dd HH:mm:ss' (UTC session); 0/null -> ''."""
    x = _c(c)
    return F.when(x.isNull() | (x == 0), F.lit("")).otherwise(
        F.date_format(F.timestamp_seconds(x), fixed.DATETIME_FORMAT))


def pad_truncate(ids, length: int, pad: int = 0):
    """Fixed-length id array and its attention mask."""
    a = _c(ids)
    padded = F.slice(F.concat(a, F.array_repeat(F.lit(pad), length)), 1, length)
    mask = F.slice(F.concat(F.array_repeat(F.lit(1), F.size(a)),
                            F.array_repeat(F.lit(0), length)), 1, length)
    return padded, mask


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def confidence_pct(score) -> Column:
    """Top score as a percentage: x100, round half up, clamp 0..100;
    zero, NaN or missing -> 0."""
    s = _c(score)
    bad = s.isNull() | F.isnan(s) | (s == 0)
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(s * 100 + 0.5)))
    return F.when(bad, F.lit(0)).otherwise(pct.cast("int"))


def overall_confidence(a, b) -> Column:
    """Mean of two already rounded confidences, rounded and clamped again."""
    m = (_c(a) + _c(b)) / 2.0
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(m + 0.5))).cast("int")


def char_count(c) -> Column:
    return F.char_length(py_strip(_c(c)))


def stable_id(url) -> Column:
    """Deterministic record id (md5 of the url) so re-runs agree."""
    return F.md5(_c(url))


def sha_order(seed: int, key) -> Column:
    """Partition-independent pseudo-random order key: md5('seed|key')."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _c(key).cast("string")))
