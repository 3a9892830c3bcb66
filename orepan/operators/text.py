"""Text evidence: chunks, term search, hybrid retrieval, redaction and citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .geometry import ranked

#: Words in names of secrets, the characters of such names, and what is masked, in this order.
SECRET_WORD = "(?:API[_-]?KEY|TOKEN|PASSWORD|SECRET|CREDENTIAL)"
NAME_LETTER = "[A-Z0-9_.-]"
#: A whole run of name letters that holds such a word and goes before an assignment.  It is looked at once only,
#: from its beginning, so a long run without an assignment takes one pass.
SECRET_NAME = rf"(?<!{NAME_LETTER})(?={NAME_LETTER}++%s\s*+[:=]){NAME_LETTER}*?{SECRET_WORD}{NAME_LETTER}*+"


def _folders(mark: str, part: str) -> str:
    """One or more folders, each ended by ``mark``, with something behind them; a path may go on after , and ;."""
    return rf"(?:{part}++{mark}(?:[,;]{part}*+{mark})*+(?=[^\s,;:]))++[^\s,;:]++"


REDACTIONS = (
    (rf"""(?idU)(["']?{SECRET_NAME % '["\']?'}["']?\s*[:=]\s*)(["'])(.*?)\2""", "$1$2[REDACTED]$2"),
    (rf"(?iU)({SECRET_NAME % ''}\s*[:=]\s*)[^\s,;}}]+", "$1[REDACTED]"),
    (r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?U)(?<![\w.])/" + _folders("/", r"[^\s/:]"), "[INTERNAL_PATH]"),
    (r"(?iU)\b[A-Z]:[\\/]" + _folders(r"[\\/]", r"[^\s\\/:]"), "[INTERNAL_PATH]"),
)

#: Documents and queries that one task of the term search counts together.
TASK_DOCS, TASK_QUERIES = 4000, 4000


def redact(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def terms(text: Column) -> Column:
    """Distinct lower-case terms: letters, digits, ``_ . -``; and single Han characters and their pairs."""
    lower = F.lower(text)
    plain = F.regexp_extract_all(lower, F.lit("([a-z0-9_.-]+)"), F.lit(1))
    runs = F.regexp_extract_all(lower, F.lit(r"(\p{IsHan}+)"), F.lit(1))
    singles = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(plain, singles, pairs))


def chunk_fixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1800) -> DataFrame:
    """Chunks at fixed offsets, trimmed, blank ones out; ``chunk_id`` hashes (id, offset, text)."""
    offsets = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size))
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.trim(F.substring(F.col(text_col), o + 1, F.lit(size))).alias("text"))))).select("doc_id", F.col("pos").alias("chunk_no"), F.col("col.offset").alias("offset"), F.col("col.text").alias("text"))
    return rows.where(F.col("text") != "").withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("\0", F.col("doc_id").cast("string"), F.col("offset").cast("string"), "text"), 256), 1, 20))


#: Fixed value: a heading has one to six marks, white space and a name.
HEADING = re.compile(r"#{1,6}\s+(.+?)\s*$")


def passages(text: str, size: int = 1800):
    """(section, lines joined): a heading ends a passage and opens a section, as do ``size`` characters of lines."""
    section, lines, held = None, [], 0
    for line in [*text.splitlines(), None]:
        heading = HEADING.match(line) if line is not None else None
        if line is not None and not heading:
            lines.append(line)
            held += len(line) + 1
        if line is None or heading or held >= size:
            yield section, "\n".join(lines)
            lines, held = [], 0
        section = heading.group(1) if heading else section


def section_pieces(text: str, size: int = 1800):
    """(section, piece as cut) of one text; white space at a piece's end is part of the cut.

    A passage, trimmed, is cut at its last line end past the half of ``size``, else at ``size``.
    """
    for section, passage in passages(text, size):
        rest = passage.strip()
        while len(rest) > size:
            line_end = rest.rfind("\n", size // 2 + 1, size)
            at = size if line_end < 0 else line_end
            yield section, rest[:at]
            rest = rest[at:].lstrip()
        if rest:
            yield section, rest


def chunk_sections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1800) -> DataFrame:
    """Markdown chunks by ``section_pieces``: ``doc_id, chunk_no, section, text, chunk_id``.

    The id is of section, number and the piece as it was cut; the text is the trimmed piece.

    Where a piece is cut depends on what was cut before, so each document is one sequential step; documents are
    independent and are read partition by partition.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(d, n, s, p) for d, t in zip(pdf[id_col], pdf[text_col]) for n, (s, p) in enumerate(section_pieces(t or "", size))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "section", "cut"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(id_col, text_col).mapInPandas(run, f"doc_id {kind}, chunk_no int, section string, cut string")
    chunk_id = F.substring(F.sha2(F.concat_ws("\0", F.coalesce("section", F.lit("")), F.col("chunk_no").cast("string"), "cut"), 256), 1, 20)
    trimmed = F.regexp_replace("cut", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return found.select("doc_id", "chunk_no", "section", trimmed.alias("text"), chunk_id.alias("chunk_id"))


def best_page_text(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Longest extracted text per page (the first extractor in ``pref`` order on ties), and whether it looks scanned."""
    best = pages.groupBy(*keys).agg(F.max_by("text", F.struct(F.length("text"), -F.col("pref"))).alias("text"))
    return best.withColumn("scan_like", F.length(F.regexp_replace("text", r"\s", "")) < 40)


def term_search(docs: DataFrame, queries: DataFrame, *, k: int = 10, first: int = 8, most: int = TASK_DOCS, block: int = TASK_QUERIES) -> DataFrame:
    """Shared terms / query terms for many queries at once; documents without a shared term are left out.

    ``docs``: id, tokens (distinct); ``queries``: query_id, tokens (distinct).  Ties go to the smaller id.

    Documents are dealt into parts of about ``most`` and queries into blocks of about ``block``; each part meets each block
    once.  There the documents of a term are a list, a query adds up the lists of all its terms, and its ``k`` best
    documents of the part go on.  So the documents' terms are made and shuffled once a block, no row is made for a document
    that a query shares words with, and more documents make more parts, not larger ones.  ``first`` is without effect: it
    was the number of terms that a former bound began with.
    """
    parts, blocks = 1 + docs.count() // most, 1 + queries.count() // block
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    held = docs.where("id is not null").select("id", "tokens", one("id", parts).alias("part"), every(blocks).alias("block"))
    asked = queries.where("query_id is not null").select("query_id", "tokens", every(parts).alias("part"), one("query_id", blocks).alias("block"))

    def best(held, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.unique(pc.list_flatten(asked["tokens"])).drop_null()
        ids = pc.unique(held["id"])
        ids = ids.take(pc.sort_indices(ids))

        def pairs(column, rows):
            """Numbers of words, ascending, and of the rows that hold them, each pair once."""
            lists = column.combine_chunks()
            found = pc.index_in(pc.list_flatten(lists), value_set=words)
            row, word = (x.filter(found.is_valid()).to_numpy().astype("int64") for x in (pc.list_parent_indices(lists), found))
            return np.divmod(np.unique(word * len(rows) + rows[row]), max(len(rows), 1))

        word, doc = pairs(held["tokens"], pc.index_in(held["id"], value_set=ids).to_numpy())
        at = np.searchsorted(word, np.arange(len(words) + 1))
        word, query = pairs(asked["tokens"], np.arange(asked.num_rows))
        own = np.split(word[np.argsort(query, kind="stable")], np.cumsum(np.bincount(query, minlength=asked.num_rows))[:-1])
        found = [(np.empty(0, "int64"),) * 3]
        for i, terms in enumerate(own if len(ids) else []):
            common = np.bincount(np.concatenate([np.empty(0, "int64"), *(doc[at[t] : at[t + 1]] for t in terms)]), minlength=len(ids))
            top = np.flatnonzero(common)
            if len(top) > k:
                top = top[np.argpartition(top - common[top] * len(ids), k - 1)[:k]]
            found.append((np.full(len(top), i), top, common[top]))
        i, top, common = (np.concatenate(x) for x in zip(*found))
        asked = asked.take(pa.array(i))
        return pa.table({"query_id": asked["query_id"], "id": ids.take(pa.array(top)), "common": pa.array(common, "int64"), "n": pc.list_value_length(asked["tokens"]).cast("int64")})

    rows = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(best, f"query_id {dict(queries.dtypes)['query_id']}, id {dict(docs.dtypes)['id']}, common long, n long")
    ranks = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("common"), "id"))
    return rows.withColumn("rank", ranks).where(F.col("rank") <= k).select("query_id", "id", (F.col("common").cast("double") / F.col("n")).alias("score"), "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hybrid_search(chunks: DataFrame, *, keyword: str, vector: list[float], k: int = 10, rrf: int = 60) -> DataFrame:
    """Keyword branch in id order and vector branch by cosine, 2k rows each, fused by 1 / (rrf + rank).

    ``chunks``: id, text, embedding (null: keyword branch only).
    """
    lexical = ranked(chunks.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).select("id"), ["id"], 2 * k)
    dense = chunks.where("embedding is not null").select("id", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector))).alias("cos"))
    dense = ranked(dense.where("cos is not null"), ["cos desc", "id"], 2 * k)
    rows = lexical.select("id", F.lit(0).alias("b"), "rank").unionByName(dense.select("id", F.lit(1).alias("b"), "rank"))
    parts = F.sort_array(F.collect_list(F.struct("b", "rank")))
    merged = rows.groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.lit(1.0) / (rrf + x["rank"])).alias("score"))
    return ranked(merged, ["score desc", "id"], k)


def check_citations(answers: DataFrame, *, text: str = "text", known: str = "known", pattern: str = r"\[([a-z]+:[A-Za-z0-9_-]+)\]") -> DataFrame:
    """Citations of an answer that are known, the unknown ones taken out, and the first known added if none is left."""
    cited = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    out = answers.withColumns({"valid": F.array_intersect(cited, known), "invalid": F.array_except(cited, known)})
    cleaned = F.trim(F.aggregate("invalid", F.col(text), lambda s, c: F.replace(s, F.concat(F.lit("["), c, F.lit("]")), F.lit(""))))
    added = F.when((F.size("valid") == 0) & (F.size(known) > 0), F.concat(cleaned, F.lit(" ["), F.get(F.col(known), F.lit(0)), F.lit("]"))).otherwise(cleaned)
    return out.withColumn("checked", added)


def quality_failures(text: Column, *, least: int = 0, contains: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> Column:
    """Messages of the output checks that fail, in order."""
    checks = [F.when(F.length(text) < least, F.lit("too_short"))]
    checks += [F.when(~F.contains(text, F.lit(c)), F.lit(f"missing:{c}")) for c in contains]
    checks += [F.when(F.contains(text, F.lit(c)), F.lit(f"forbidden:{c}")) for c in excludes]
    return F.array_compact(F.array(*checks))


def shortened(text: Column, most: int = 1200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def route_keywords(messages: DataFrame, packs: DataFrame, dependencies: DataFrame, available: DataFrame) -> DataFrame:
    """Tools per message: of every pack with a term in the text, with their dependencies, if available; else all.

    ``messages``: id, text; ``packs``: term, tool; ``dependencies``: tool, needs; ``available``: tool.
    Packs are a configuration table and are broadcast.
    """
    hit = messages.join(F.broadcast(packs), F.contains(F.lower("text"), F.lower("term"))).select("id", "tool").distinct()
    needed = hit.join(F.broadcast(dependencies), "tool").select("id", F.col("needs").alias("tool"))
    chosen = hit.unionByName(needed).distinct().join(F.broadcast(available), "tool", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("tool")).alias("tools"))
    every = available.agg(F.sort_array(F.collect_set("tool")).alias("every"))
    return messages.select("id").join(chosen, "id", "left").join(F.broadcast(every)).select("id", F.coalesce("tools", "every").alias("tools"), F.col("tools").isNull().alias("fallback"))


def safe_source(source: Column) -> Column:
    """Reasons against naming a source: absolute or home path, file URL, credentials or query in a web address."""
    rules = {
        "absolute_path": r"^(?:[/~]|[A-Za-z]:[\\/]|\\\\[^\\]+\\[^\\]+)",
        "file_url": r"^(?i:file):",
        "credentials": r"^(?i:https?)://[^/?#]+@",
        "query_or_fragment": r"^(?i:https?)://[^?#]*(?:\?[^#]+|\??#.)",
    }
    return F.array_compact(F.array(*(F.when(F.rlike(source, F.lit(pattern)), F.lit(name)) for name, pattern in rules.items())))


def url_host(url: Column) -> Column:
    """Host of an https address in lower case; null for other addresses and where there is none.

    The authority ends at the first ``/``, ``?`` or ``#``; user info ends at its last ``@``; line ends and tabs count for nothing,
    as do control characters and spaces in front, and dots at the end of the host.
    """
    plain = F.regexp_replace(F.regexp_replace(url, "[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    authority = F.regexp_extract(plain, r"^(?i:https)://([^/?#]*)", 1)
    address = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(F.startswith(address, F.lit("[")), F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(address, r"^([^:]*)", 1))
    return F.nullif(F.lower(F.regexp_replace(host, r"\.+$", "")), F.lit(""))


def allowed_host(urls: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``allowed``: https and exactly a host of the list (in any case, dots at the end aside)."""
    listed = hosts.select(F.lower(F.regexp_replace("host", r"\.+$", "")).alias("host"), F.lit(True).alias("ok")).distinct()
    return urls.withColumn("host", url_host(F.col(url))).join(listed, "host", "left").withColumn("allowed", F.coalesce("ok", F.lit(False))).drop("ok")
