"""Article citations: normal form, extraction, verification against evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haystrata.functions import patterns as P

_ARTICLE = P.unicode_pattern(P.ARTICLE, ignore_case=False)


def _canonical(number: Column, branch: Column) -> Column:
    return F.concat(F.lit("제"), number, F.lit("조"), F.when(branch == "", "").otherwise(F.concat(F.lit("의"), branch)))


def normal_article(text: Column) -> Column:
    """The first article named, in normal form; null if there is none."""
    return F.when(text.rlike(_ARTICLE), _canonical(F.regexp_extract(text, _ARTICLE, 1), F.regexp_extract(text, _ARTICLE, 2)))


def cited_articles(text: Column) -> Column:
    """Distinct articles in order."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ARTICLE), F.lit(0))
    return F.array_distinct(F.transform(every, lambda a: _canonical(F.regexp_extract(a, _ARTICLE, 1), F.regexp_extract(a, _ARTICLE, 2))))


def verify(answer: Column, articles: Column) -> Column:
    """struct: citation_verified, cited_articles, unsupported_cited_articles, available_articles. ``articles``: array of evidence articles."""
    available = F.array_sort(F.array_distinct(F.filter(F.transform(articles, normal_article), lambda a: a.isNotNull())))
    cited = cited_articles(answer)
    missing = F.array_except(cited, available)
    return F.struct((F.size(missing) == 0).alias("citation_verified"), cited.alias("cited_articles"), missing.alias("unsupported_cited_articles"), available.alias("available_articles"))


def guarded_answer(answer: Column, citation: Column) -> Column:
    """The answer, or null where it cites what the evidence does not hold."""
    return F.when(citation["citation_verified"], answer)


def clean_answer(text: Column) -> Column:
    """Without thinking marks, white space squeezed."""
    from haystrata.functions.spans import squeeze

    return squeeze(F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|\z)", ""))


def snippet(text: Column, limit: int = 260) -> Column:
    from haystrata.functions.spans import squeeze

    flat = squeeze(text)
    cut = F.regexp_replace(F.substring(flat, 1, limit - 1), f"{P.WS}+$", "")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def evidence_block(matches: Column, most: int = 5, chars: int = 700) -> Column:
    """Numbered lines of matches (source, file_name, article, article_title, snippet)."""

    def line(m: Column, i: Column) -> Column:
        source = F.coalesce(F.nullif(m["source"], F.lit("")), F.nullif(m["file_name"], F.lit("")), F.lit("unknown"))
        article = F.array_join(F.filter(F.array(m["article"], m["article_title"]), lambda x: x.isNotNull() & (x != "")), " ")
        article = F.when(article == "", "-").otherwise(article)
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source="), source, F.lit(" article="), article, F.lit(" snippet="), F.substring(F.coalesce(m["snippet"], F.lit("")), 1, chars))

    return F.array_join(F.transform(F.slice(matches, 1, most), line), "\n")
