"""Document fingerprints: a hash tree over phrases, paragraphs and sections.

A paragraph is a line; a phrase is up to ``PHRASE`` words of it, counted from its start. Phrase digests make the
digest of their paragraph, paragraph digests that of their section, section digests the root. A section ends
with an empty paragraph or with one whose digest starts with 0 or 1, so that its borders move with the text when
something is put in front. Digests are whole SHA-256 sums, so equal roots mean equal texts. Where roots differ, sections
that the other text has as well are left out, and in the others the paragraphs that one of its other sections has:
what remains are the places of all differing branches. The share of common phrases, told apart by 64 bits, says how much
is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.exact_dedup import sha256
from logtide.llm.pseudonyms import _let
from logtide.llm.rows import part_of, parts_for, row_hash, split_points

#: Up to 12 words with the blank behind each; words above 64 characters count as several.
PHRASE = r"(?: |[^ ]{1,64} ?){1,12}"


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with ``{prefix}root`` (hex), ``{prefix}sections`` and ``{prefix}phrases`` of a non-null text column.

    A section is its paragraph digests, each followed by a comma; ``phrases`` are distinct.
    """
    phrases, paragraphs, joined, sections = (f"_{prefix}{x}" for x in ("by_line", "lines", "joined", "parts"))
    short = F.transform(F.split(text, "\n", -1), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), sha256))
    line = F.transform(F.col(phrases), lambda u: sha256(F.concat(F.lit("p"), F.array_join(u, ""))))
    # the digest of an empty paragraph is that of "p"; it ends a section like any digest from 0 or 1 on
    mark = F.transform(F.col(paragraphs), lambda d: F.concat(
        d, F.when(d.rlike("^[01]") | (d == sha256(F.lit("p"))), ",|").otherwise(",")))
    root = sha256(F.concat(F.lit("r"), F.array_join(
        F.transform(F.col(sections), lambda s: sha256(F.concat(F.lit("s"), s))), "")))
    df = df.withColumn(phrases, short).withColumn(paragraphs, line).withColumn(joined, F.array_join(mark, ""))
    df = df.withColumn(sections, F.filter(F.split(joined, r"\|"), lambda s: s != ""))
    return df.withColumns({f"{prefix}root": root, f"{prefix}sections": F.col(sections),
                           f"{prefix}phrases": F.array_distinct(F.transform(
                               F.flatten(phrases), lambda d: F.substring(d, 1, 16)))}).drop(
        phrases, paragraphs, joined, sections)


def likeness(a: str, b: str) -> Column:
    """Twice the common phrases by the sum of both; 1 for two texts without any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _only_own(own: Column, other: Column) -> Column:
    """The structs of ``own`` whose digest ``d`` is in none of ``other``, one (the least) for each digest, by digest.

    Both have the same fields, ``d`` first and then ``mine`` (1 in own, 0 in other). One sort puts equal digests side
    by side, those of ``other`` in front, so a neighbour decides and long texts take no more than sorting.
    """
    def pick(both):
        return F.filter(both, lambda x, k: (x["mine"] == 1) & ~F.coalesce(
            F.get(both, k - 1)["d"] == x["d"], F.lit(False)))

    return _let(F.array_sort(F.concat(other, own)), pick)


def _sections(sections: Column, mine: int) -> Column:
    return F.transform(sections, lambda s, k: F.struct(s.alias("d"), F.lit(mine).alias("mine"), k.alias("section")))


def _paragraphs(sections: Column, mine: int) -> Column:
    """Paragraph digests of the given section structs, with their places."""
    return F.flatten(F.transform(sections, lambda s: F.transform(
        F.filter(F.split(s["d"], ","), lambda d: d != ""), lambda d, k: F.struct(
            d.alias("d"), F.lit(mine).alias("mine"), s["section"].alias("section"), k.alias("paragraph")))))


def changes(a: Column, b: Column) -> Column:
    """Places (section, and paragraph in it, from 0) of the paragraphs of ``a`` that no differing section of ``b`` has,
    the first place of each; ``a`` and ``b`` are sections of two trees. Common sections are not descended into."""
    def inside(odd):
        own, other = _paragraphs(odd["a"], 1), _paragraphs(odd["b"], 0)
        return F.array_sort(F.transform(_only_own(own, other), lambda x: F.struct(x["section"], x["paragraph"])))

    return _let(F.struct(_only_own(_sections(a, 1), _sections(b, 0)).alias("a"),
                         _only_own(_sections(b, 1), _sections(a, 0)).alias("b")), inside)


def written_places(places: str) -> Column:
    """Places as ``section:paragraph``, comma-joined."""
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", x["section"], x["paragraph"])), ",")


def with_next(docs: DataFrame, columns: list[str], ascending: bool = False) -> DataFrame:
    """``docs`` with ``next_<column>``: the columns of the following document by doc_id, after the last the first.

    ``docs`` has doc_id and ``_hash``, which orders rows of one doc_id. Rows are dealt to parts that are ranges of
    this order; the border row of each part is also dealt to the neighbour that needs it. No part depends on
    another, and no row passes through a single task. Null ids are below all others.
    """
    order = ["doc_id", "_hash"]
    cuts = split_points(docs, order, parts_for(docs))
    placed = docs.withColumn("_part", part_of(docs, order, cuts))
    pick = F.min if ascending else F.max
    borders = placed.select("_part", *order).groupBy("_part").agg(pick(F.struct(*order)).alias("b")).collect()
    filled = sorted(r["_part"] for r in borders)  # at most one row per part
    step = -1 if ascending else 1
    to = {p: filled[(k + step) % len(filled)] for k, p in enumerate(filled)}
    border = docs.sparkSession.createDataFrame(
        [(r["_part"], r["b"]["doc_id"], r["b"]["_hash"], to[r["_part"]]) for r in borders],
        f"_part int, _b_id {dict(docs.dtypes)['doc_id']}, _b_hash long, _to int")
    placed = placed.join(F.broadcast(border), "_part")
    on_border = F.col("doc_id").eqNullSafe(F.col("_b_id")) & (F.col("_hash") == F.col("_b_hash"))
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_to").alias("part"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("_at", F.explode(F.when(on_border, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"_part": F.col("_at.part"), "_guest": F.col("_at.guest")}).drop(
        "_at", "_b_id", "_b_hash", "_to")
    window = Window.partitionBy("_part").orderBy(F.col("_guest").desc(), *[F.col(c) for c in order])
    look = F.lag
    if ascending:
        window, look = Window.partitionBy("_part").orderBy(F.col("_guest"), *[F.col(c) for c in order]), F.lead
    return dealt.withColumns({f"next_{c}": look(c).over(window) for c in columns}).filter("not _guest").drop(
        "_part", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, root, sections, phrases. A null text counts as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_tree(rows, "text", "").select("doc_id", "root", "sections", "phrases")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents beside those of their edited texts and of the next documents.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document
    in descending doc_id; after the last comes the first, so a single document is its own next. Null texts count
    as empty; a null doc_id comes after all others; rows of one doc_id are ordered by a hash. Returns doc_id,
    n_chars, edited_text, root, edited_root, near_edited, near_next, sections, and ``removed`` and ``added``, the places
    of all differing branches in the tree of the text and in that of the edited one (``changes``; none where the roots
    are equal). An empty table gives no rows. Only doc_id, text and the row hash are used.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_hash(docs).alias("_hash"))
    treed = with_tree(rows, "text", "")
    # the order needs no texts: cuts and borders are found on rows without trees, which the optimizer prunes
    paired = with_next(treed, ["text", "phrases"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.withColumns({"n_chars": F.length("text").cast("long"), "edited_text": edited})
    paired = with_tree(paired.drop("text", "next_text"), "edited_text", "edited_")
    paired = paired.withColumns({"removed": changes(F.col("sections"), F.col("edited_sections")),
                                 "added": changes(F.col("edited_sections"), F.col("sections"))})
    return paired.select(
        "doc_id", "n_chars", "edited_text", "root", "edited_root", likeness("phrases", "edited_phrases").alias("near_edited"),
        likeness("phrases", "next_phrases").alias("near_next"), F.size("sections").alias("sections"), "removed",
        "added")


_TREE = r"""{0}_lines AS (SELECT doc_id, list_transform(string_split({1}, chr(10)), lambda p: list_transform(
    regexp_extract_all(p, '(?: |[^ ]{{1,64}} ?){{1,12}}'), lambda u: sha256(u))) AS u FROM {2}),
  {0}_digests AS (SELECT doc_id, u, list_transform(u, lambda x: sha256('p' || array_to_string(x, ''))) AS d FROM {0}_lines),
  {0}_sections AS (SELECT doc_id, u, list_filter(string_split(array_to_string(list_transform(d, lambda x: x || CASE
    WHEN x < '2' OR x = sha256('p') THEN ',|' ELSE ',' END), ''), '|'), lambda s: s <> '') AS s
    FROM {0}_digests),
  {0} AS (SELECT doc_id, s, sha256('r' || array_to_string(list_transform(s, lambda x: sha256('s' || x)), '')) AS root,
    list_distinct(list_transform(flatten(u), lambda d: substr(d, 1, 16))) AS phrases FROM {0}_sections),
  {0}_each AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM {0})"""

#: Places of the differing branches of tree 0 against tree 1.
_CHANGES = r"""{0}_odd AS (SELECT doc_id, s, min(i) AS i FROM {0}_each WHERE (doc_id, s) NOT IN (SELECT doc_id, s FROM {1}_each)
    GROUP BY ALL),
  {0}_par AS (SELECT doc_id, i, unnest(p) AS d, generate_subscripts(p, 1) - 1 AS j FROM (
    SELECT doc_id, i, list_filter(string_split(s, ','), lambda x: x <> '') AS p FROM {0}_odd))"""
_PLACES = r"""{0}_at AS (SELECT doc_id, string_agg(place.i || ':' || place.j, ',' ORDER BY place) AS places FROM (
    SELECT doc_id, d, min({{'i': i, 'j': j}}) AS place FROM {0}_par WHERE (doc_id, d) NOT IN (SELECT doc_id, d FROM {1}_par)
    GROUP BY ALL) GROUP BY doc_id)"""

_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"

#: What ``op8_document_fingerprints`` returns, said in SQL.
SQL = ("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
       "n AS (SELECT doc_id, t, coalesce(lag(doc_id) OVER w, max(doc_id) OVER ()) AS next_id, "
       "coalesce(lag(t) OVER w, last_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED "
       "FOLLOWING)) AS next_t FROM d WINDOW w AS (ORDER BY doc_id)), "
       "e AS (SELECT doc_id, next_id, length(t) AS n_chars, substr(t, 1, length(t) - length(t) // 2) || "
       "substr(next_t, 1, length(t) // 2) AS edited FROM n), "
       + _TREE.format("own", "t", "d") + ", " + _TREE.format("chg", "edited", "e") + ", "
       + ", ".join(x.format(*pair) for x in (_CHANGES, _PLACES) for pair in (("own", "chg"), ("chg", "own"))) + " SELECT e.doc_id, n_chars, "
       "sha256(edited) AS edited_sha256, own.root AS fingerprint, chg.root AS edited_fingerprint, "
       f"round({_LIKE.format('own.phrases', 'chg.phrases')}, 9) AS near_edited, "
       f"round({_LIKE.format('own.phrases', 'nxt.phrases')}, 9) AS near_next, "
       "coalesce(own_at.places, '') AS removed, coalesce(chg_at.places, '') AS added "
       "FROM e JOIN own USING (doc_id) JOIN chg USING (doc_id) JOIN own AS nxt ON nxt.doc_id = next_id "
       "LEFT JOIN own_at ON own_at.doc_id = e.doc_id LEFT JOIN chg_at ON chg_at.doc_id = e.doc_id")
