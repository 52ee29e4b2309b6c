"""Text expressions: cleaning, id-list parsing, tokenising.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
no Python UDF is involved.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# English stop-word list used by the cleaner and by the TF-IDF tokeniser
# (the common 318-word English list shipped with scikit-learn), alphabetical.
STOP_WORDS_TEXT = """
a about above across after afterwards again against all almost alone along
already also although always am among amongst amoungst amount an and another
any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below
beside besides between beyond bill both bottom but by call can cannot cant co
con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone
everything everywhere except few fifteen fifty fill find fire first five for
former formerly forty found four from front full further get give go had has
hasnt have he hence her here hereafter hereby herein hereupon hers herself him
himself his how however hundred i ie if in inc indeed interest into is it its
itself keep last latter latterly least less ltd made many may me meanwhile
might mill mine more moreover most mostly move much must my myself name namely
neither never nevertheless next nine no nobody none noone nor not nothing now
nowhere of off often on once one only onto or other others otherwise our ours
ourselves out over own part per perhaps please put rather re same see seem
seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still
such system take ten than that the their them themselves then thence there
thereafter thereby therefore therein thereupon these they thick thin third
this those though three through throughout thru thus to together too top
toward towards twelve twenty two un under until up upon us very via was we
well were what whatever when whence whenever where whereafter whereas whereby
wherein whereupon wherever whether which while whither who whoever whole whom
whose why will with within without would yet you your yours yourself
yourselves
"""
STOP_WORDS: tuple[str, ...] = tuple(STOP_WORDS_TEXT.split())

# Cleaning patterns, applied in this order after lower-casing.
URL_PATTERN = r"http\S+|www\.\S+"
TAG_PATTERN = r"<[^>]+>"
NON_ALNUM_PATTERN = r"[^a-z0-9\s]+"
SPACE_PATTERN = r"\s+"
# Separators of messy tweet-id lists, and the blank markers treated as empty.
ID_SEPARATOR_PATTERN = r"[,\t;|\s]+"
ID_BLANK_MARKERS = ("", "nan", "none", "[]")
# ---------------------------------------------------------------------------


def stop_words_array() -> Column:
    """The stop list as an array literal (a constant folded into the plan)."""
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def is_stop_word(w: Column) -> Column:
    """Membership test; Catalyst turns the long IN list into a hash-set lookup (InSet)."""
    return w.isin(*STOP_WORDS)


def label_name(col: Column) -> Column:
    """Label code -> fake / real / unknown."""
    return F.when(col == 0, F.lit("fake")).when(col == 1, F.lit("real")).otherwise(F.lit("unknown"))


def normalize_text(col: Column) -> Column:
    """lower -> strip URLs -> strip tags -> non [a-z0-9 space] to space -> squeeze, trim."""
    txt = F.lower(col)
    txt = F.regexp_replace(txt, URL_PATTERN, " ")
    txt = F.regexp_replace(txt, TAG_PATTERN, " ")
    txt = F.regexp_replace(txt, NON_ALNUM_PATTERN, " ")
    txt = F.regexp_replace(txt, SPACE_PATTERN, " ")
    return F.trim(txt)


def clean_text(col: Column) -> Column:
    """Cleaned text with stop words dropped; null input gives the empty string."""
    words = F.split(normalize_text(col), " ")
    kept = F.filter(words, lambda w: ~is_stop_word(w))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def parse_ids(col: Column) -> Column:
    """Messy id list -> array<string> of tokens that contain a digit."""
    trimmed = F.trim(col)
    blank = col.isNull() | F.lower(trimmed).isin(*ID_BLANK_MARKERS)
    parts = F.split(trimmed, ID_SEPARATOR_PATTERN)
    kept = F.filter(parts, lambda p: (p != F.lit("")) & p.rlike(r"\d"))
    return F.when(blank, F.array().cast("array<string>")).otherwise(kept)


def vector_tokens(clean_col: Column) -> Column:
    """Tokens the vectoriser keeps from cleaned text: words of two or more characters
    that are not stop words (cleaned text is already [a-z0-9] words split by spaces)."""
    return F.filter(F.split(clean_col, " "),
                    lambda w: (F.length(w) >= 2) & ~is_stop_word(w))


def unigrams_and_bigrams(tokens: Column) -> Column:
    """Unigrams followed by space-joined bigrams of consecutive tokens."""
    n = F.size(tokens)
    bigrams = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(1), n - 1),
                    lambda i: F.concat(F.element_at(tokens, i), F.lit(" "), F.element_at(tokens, i + 1))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, bigrams)


def snippet(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters, with ``...`` where something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
