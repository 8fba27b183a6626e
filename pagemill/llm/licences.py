"""Licence scans by canonical digest: built-in functions only.

A text is brought to a canonical form (case, spellings, copyright lines, punctuation
and white space evened out) and hashed; the digest is joined to those of known
licences. Entire texts are looked up, and runs of whole lines, however a licence is
wrapped: a run starts with the first word of a known text and has as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal, the left one becomes the right one.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("http:", "https:"),
    ("&", "and"),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
BLANKS = r" *\n[ \n]*"
# Lines of a wrapped licence that start with the word, and are no copyright line of their own.
WRAPPED_COPYRIGHT = (
    r"(?im)^([ \t]*)(?=copyright[ \t]+(?:holders?|owners?|notices?|laws?|licen[cs]es?|licensed|statements?|disclaimers?|interests?|rights?"
    r"|ownership|permissions?|treaty|status|and|or|in|on|as|for|to|is|are|be|may|can|shall|resulting|protection|permission)\b)"
)


def canonical(text: Column) -> Column:
    """Canonical form of a text: its lines of words with single spaces between, none of them empty."""
    out = F.lower(text)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.btrim(F.regexp_replace(out, BLANKS, "\n"), F.lit(" \n"))


def digest(canonical_text: Column) -> Column:
    """Digest of a canonical text, wherever its lines break."""
    return F.sha2(F.replace(canonical_text, F.lit("\n"), F.lit(" ")), 256)


def form(text: Column) -> Column:
    """Canonical form in which a licence is the same however it is wrapped."""
    return canonical(F.regexp_replace(text, WRAPPED_COPYRIGHT, "$1."))


def runs(words: Column, counts: dict[str, set[int]]) -> Column:
    """Runs (start, n) of whole lines that start with the first word of a licence and have as many words."""
    if not counts:
        return F.expr("cast(array() AS array<struct<start: int, n: int>>)")
    sizes = F.create_map(*(c for w, ns in sorted(counts.items()) for c in (F.lit("\n" + w), F.array(*map(F.lit, sorted(ns))))))
    starts = F.transform(words, lambda w, i: F.when(w.startswith("\n"), F.struct(i.alias("start"), F.try_element_at(sizes, w).alias("ns"))))
    starts = F.filter(starts, lambda s: s["ns"].isNotNull())

    def whole(s: Column) -> Column:
        last = F.size(words)
        ends = lambda n: (s["start"] + n == last) | F.coalesce(F.get(words, s["start"] + n).startswith("\n"), F.lit(False))
        return F.transform(F.filter(s["ns"], ends), lambda n: F.struct(s["start"].alias("start"), n.alias("n")))

    return F.flatten(F.transform(starts, whole))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Licences(licence, text) found in docs(doc_id, text), a row per doc_id.

    doc_id, licence (that the entire text is; of several that have one canonical form
    the least), notices (licences that a line is, or a run of lines short of the entire
    text, sorted, joined by commas; empty if none) and n_notices (such lines and runs; one
    that lies within another counts too). Null and empty texts, and licences whose
    canonical form is empty, match nothing. Rows that share a doc_id are taken together;
    a null doc_id gives one row without findings. Other columns are left out. The driver
    gets the first words and numbers of words of the licences. Spark broadcasts the
    licences only where their size allows; a hot digest is otherwise split by the skew join.
    """
    known = licences.select(F.col("licence").cast("string"), form(F.col("text")).alias("body")).where("body <> ''")
    known = known.withColumn("body", F.replace("body", F.lit("\n"), F.lit(" ")))
    words = F.split("body", " ")
    counts: dict[str, set[int]] = {}
    for r in known.select(words[0].alias("word"), F.size(words).alias("n")).distinct().collect():
        counts.setdefault(r["word"], set()).add(r["n"])
    known = known.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("licence").alias("licence"))
    texts = docs.select(F.col("doc_id").cast("long"), form(F.col("text")).alias("body")).where("doc_id IS NOT NULL AND body <> ''")
    # Words in order; a line feed stands before the first of each line.
    texts = texts.select("doc_id", F.split(F.concat(F.lit("\n"), F.replace("body", F.lit("\n"), F.lit(" \n"))), " ").alias("words"))
    units = texts.select("doc_id", "words", F.explode(runs(F.col("words"), counts)).alias("run"))
    own = F.expr("array_join(slice(words, run.start + 1, run.n), ' ')")
    units = units.select(
        "doc_id",
        F.expr("run.start = 0 AND run.n = size(words)").alias("entire"),
        (F.locate("\n", own, 2) == 0).alias("line"),
        digest(F.replace(own, F.lit("\n"), F.lit(""))).alias("digest"),
    )
    found = units.join(known, "digest")
    notice = F.col("line") | ~F.col("entire")
    found = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("entire"), F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(notice, F.col("licence")))), ",").alias("notices"),
        F.count_if(notice).alias("n_notices"),
    )
    ids = docs.select(F.col("doc_id").cast("long")).distinct()
    return ids.join(found, "doc_id", "left").select(
        "doc_id", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices")
    )
