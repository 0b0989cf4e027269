"""Whether a text states something that can be analysed: evidence for and against, token by token. Built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import thesaurus
from ..functions import vocabulary as V

# Bodies that number standards, units of figures, codes of grades, rows of a keyboard, and the limits of shapes.
BODIES = ("IS", "IS/IEC", "IS/ISO", "IEC", "ISO", "EN", "BS", "ASTM", "ANSI", "DIN", "JIS", "AWWA")
UNITS = ("mm", "mm2", "sqmm", "sq mm", "cm", "m", "km", "v", "kv", "mv", "a", "ma", "ka", "w", "kw", "mw", "va", "kva", "hz", "khz", "k", "lm", "lux", "lx", "cd", "nm", "kg", "g", "t", "mpa", "pa", "bar", "psi", "rpm", "hp", "deg", "°c", "c")
GRADES = ("IP ?[0-9]{2}", "IPX ?[0-9]", "IE ?[1-4]", "CM/L")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
LEAST_LETTERS, SHAPED_LETTERS, MOST_CONSONANTS, LEAST_DISTINCT, MOST_STEPS = 3, 6, 4, 3, 4
DOMINANCE, LEAST_TESTED, LEAST_FOREIGN, MOST_SHOWN = 0.8, 3, 3, 10
# End of the fixed values.

TOKEN = r"[A-Za-z0-9]+(?:[./'\-][A-Za-z0-9]+)*"
DESIGNATION = rf"(?i)\b(?:{'|'.join(sorted(BODIES, key=len, reverse=True))})\s*[:/\-]?\s*[0-9]{{2,6}}\b"
SPECIFICATION = rf"(?i)(?:\b(?:{'|'.join(GRADES)})\b|[0-9]\s*(?:%|(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})\b))"
CODE = r"\b(?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z])[A-Za-z0-9]*\b"
CONSONANTS = rf"[^aeiouy]{{{MOST_CONSONANTS + 1}}}"
#: Pairs of keys beside each other, in both directions.
STEPS = tuple(sorted({p for row in ROWS for a, b in zip(row, row[1:]) for p in (a + b, b + a)}))


def _ascii(pattern: str) -> str:
    r"""The pattern with \b and \s over ASCII alone: for Java's \b a letter of any script is a letter, and its \s has a vertical tab.
    Where case does not count, the long s and the Kelvin sign are the letters they stand for."""
    out = pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"\s", r"[\t\n\f\r ]")
    return re.sub("[kK]", "[k\u212a]", re.sub("[sS]", "[s\u017f]", out)) if out.startswith("(?i)") else out


def known_words() -> list[str]:
    """The words, of three letters or more, that the library's own rule tables say titles and tenders by."""
    texts = [w for words, _ in thesaurus.CATEGORY_RULES for w in words] + [t for _, t in thesaurus.THESAURUS]
    texts += [w for table in (V.CATEGORIES6, V.TYPES, V.CONTEXTS, V.DOMAINS) for _, words in table for w in words]
    return sorted({w for t in texts for w in re.findall(r"[a-z]{3,}", t.lower())})


def keyboard_run(letters: Column) -> Column:
    """Whether more than MOST_STEPS successive letters each stand beside the one before on the keyboard."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters) - 1, F.lit(1))), lambda i: F.when(F.substr(letters, i, F.lit(2)).isin(*STEPS), "1").otherwise("0"))
    return F.array_join(steps, "").contains("1" * (MOST_STEPS + 1))


def token_kind(token: Column, words: list[str]) -> Column:
    """vocabulary, neutral (under three letters), short or malformed (under six), shaped or gibberish.

    Short tokens are well formed with a vowel or in capitals. Longer ones are gibberish without a vowel, with five
    consonants in a row, with fewer than three different letters, or by a run along the keyboard.
    """
    letters = F.lower(F.regexp_replace(token, "[^A-Za-z]", ""))
    vowel = letters.rlike("[aeiouy]")
    odd = ~vowel | letters.rlike(CONSONANTS) | (F.size(F.array_distinct(F.split(letters, ""))) < LEAST_DISTINCT) | keyboard_run(letters)
    capitals = token.rlike("[A-Z]") & ~token.rlike("[a-z]")
    n = F.length(letters)
    kind = F.when(letters.isin(words), "vocabulary").when(n < LEAST_LETTERS, "neutral")
    return kind.when(n < SHAPED_LETTERS, F.when(vowel | capitals, "short").otherwise("malformed")).when(odd, "gibberish").otherwise("shaped")


def quality_gate(docs: DataFrame, words: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(doc_id, meaningful, reason, designation, specification, code, n_vocabulary, n_shaped, n_short, n_gibberish,
    n_malformed, n_foreign, n_tokens, rejected) of docs (doc_id, text).

    A text is turned down as `empty`; as `no_meaningful_content` if nothing speaks for it and some token is malformed; as
    `no_analysable_content` if nothing speaks for it at all; as `dominated_by_gibberish` if four fifths of three or more
    tokens of six letters are gibberish and no standard is named. For it speak a standard's number, a figure with its
    unit, a product code, a known word, a well-shaped word, three letters of another script, or more well-formed short
    tokens than malformed ones. rejected are the first ten tokens held against it. `sample` looks at the first
    characters only; by default the whole text counts.
    """
    words = known_words() if words is None else words
    text = F.trim(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", (F.left(text, F.lit(sample)) if sample else text).alias("t"))
    marked = base.withColumn("marks", F.transform(F.regexp_extract_all("t", F.lit(TOKEN), 0), lambda w: F.struct(w.alias("w"), token_kind(w, words).alias("k"))))
    n = lambda kind: F.size(F.filter("marks", lambda m: m["k"] == kind))
    counted = marked.select(
        "doc_id", "t", "marks", F.col("t").rlike(_ascii(DESIGNATION)).alias("designation"), F.col("t").rlike(_ascii(SPECIFICATION)).alias("specification"), F.col("t").rlike(_ascii(CODE)).alias("code"),
        n("vocabulary").alias("n_vocabulary"), n("shaped").alias("n_shaped"), n("short").alias("n_short"), n("gibberish").alias("n_gibberish"), n("malformed").alias("n_malformed"),
        (F.regexp_count("t", F.lit(r"\p{L}")) - F.regexp_count("t", F.lit("[A-Za-z]"))).alias("n_foreign"), F.size("marks").alias("n_tokens"),
    )
    c = F.col
    positive = c("designation") | c("specification") | c("code") | (c("n_vocabulary") + c("n_shaped") > 0) | (c("n_foreign") >= LEAST_FOREIGN) | (c("n_short") > c("n_malformed"))
    tested = c("n_shaped") + c("n_gibberish")
    drowned = ~c("designation") & (tested >= LEAST_TESTED) & (c("n_gibberish") >= DOMINANCE * tested)
    reason = F.when(c("t") == "", "empty").when(~positive & (c("n_gibberish") + c("n_malformed") > 0), "no_meaningful_content").when(~positive, "no_analysable_content").when(drowned, "dominated_by_gibberish")
    told = counted.withColumn("reason", reason)
    of = lambda kind: F.transform(F.filter("marks", lambda m: m["k"] == kind), lambda m: m["w"])
    against = F.when(c("reason") == "no_meaningful_content", F.concat(of("gibberish"), of("malformed"))).when(c("reason") == "dominated_by_gibberish", of("gibberish"))
    rejected = F.slice(F.coalesce(against, F.array().cast("array<string>")), 1, MOST_SHOWN)
    names = ("designation", "specification", "code", "n_vocabulary", "n_shaped", "n_short", "n_gibberish", "n_malformed", "n_foreign", "n_tokens")
    return told.select("doc_id", c("reason").isNull().alias("meaningful"), "reason", *names, rejected.alias("rejected"))


def page_count(text: Column) -> Column:
    """Pages of a text by its page marks; what stands before the first one is no page of its own, a text without marks is one."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?im)^[ \t]*---\s*page\s+[0-9]+\s*---[ \t]*$")), F.lit(1))
