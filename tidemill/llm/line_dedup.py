"""Line dedup by a log-template tree.

Each line goes down a tree of fixed depth: its token count, then its leading tokens; tokens that hold digits, addresses or
links are variable fields. In a leaf, lines that agree in enough of their tokens share a template, whose other fields are variable.
A template that recurs across documents is dropped from all of them.

Two lines of n tokens with at most d unlike ones agree wholly in one of d + 1 chunks of the line. So only lines that share a
chunk are compared, in a leaf as in the parts of one that is too large for a task, and templates are the connected lines either way.

Copies of whole documents are not boilerplate: near copies are linked into classes by signatures of the whole texts, and a template
recurs where texts of several classes hold it, whatever its neighbours are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import U64, RowFilter, checkpointed, hash_words, mix, ranges, slices, split_words, stored, windows, without
from tidemill.llm.graph import components, connected, links_in_groups, whole_groups
from tidemill.llm.near_dedup import _blocks

#: Leading tokens of a leaf; the share of a line's tokens that lines of a template have in common.
DEPTH, SIMILARITY = 2, 0.7
LEAST_TOKENS = 2
#: Classes of near copies that must hold a template: two, so whatever repeats across unlike documents goes. Linking may miss a copy of a
#: large group, so the classes must also be more than one for each ``TEXTS_A_CLASS`` of the texts that hold it.
LEAST_DOCUMENTS, TEXTS_A_CLASS = 2, 100
#: Near copies: 16 bands of 4 symbols meet in buckets, and are linked if this many of all symbols over two-word shingles agree.
SHINGLE, SYMBOLS, BANDS, BAND, AGREE = 2, 128, 16, 4, 80
CLASS_BLOCK = 1024
#: Different lines of a leaf that one task takes; the lines of a larger leaf are dealt by their chunks.
LEAF_LINES = 20_000
#: Parts that the occurrences of one template are dealt in.
SALTS = 16
#: A token that is a variable field.
VARIABLE = r"[0-9@]|://|^www\."
_GOLD = U64(0x9E3779B97F4A7C15)


def text_signatures(shingles: np.ndarray, ends: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """(texts, symbols) MinHash symbols of 16 bits by one permutation: the lowest hash in each of the bins that hashes fall in.

    Texts are ``shingles[ends[i]:ends[i + 1]]``, none empty. An empty bin takes the next full one's symbol, cyclically.
    """
    n, bits = len(ends) - 1, symbols.bit_length() - 1
    where = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends)) << bits | (shingles >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    ranked = where[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    out = np.zeros(n * symbols, U64)
    out[ranked[first]] = np.minimum.reduceat(shingles[order] << U64(bits), first)
    full = np.zeros(n * symbols, bool)
    full[ranked[first]] = True
    full = np.tile(full.reshape(n, symbols), 2)
    ahead = np.where(full, np.arange(2 * symbols), 2 * symbols)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :symbols] % symbols
    return (mix(np.take_along_axis(out.reshape(n, symbols), ahead, axis=1)) >> U64(48)).astype("<u2")


def line_templates(texts: pa.Array, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS) -> dict[str, np.ndarray]:
    """One entry for each line that may have a template: ``row``, ``line_no``, ``n`` (tokens), ``leaf``, ``line``, ``tokens`` (16 bits each, as
    bytes) and ``sign``: the signature of the whole text at its first such line, else None.

    A line is what ``\\n`` ends; its number counts all lines from 0. Lines of fewer tokens, or of variable fields alone, have no template.
    """
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)
    offsets, codes, dictionary = split_words(flat)
    hashes = hash_words(dictionary)
    variable = pc.match_substring_regex(dictionary, VARIABLE).to_numpy(zero_copy_only=False) if len(dictionary) else np.zeros(0, bool)
    hashes[variable] = U64(1)
    tokens = hashes[codes] if len(codes) else np.zeros(0, U64)
    lengths = np.diff(offsets)
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], lengths)
    total = np.concatenate([[U64(0)], np.cumsum(mix(tokens + mix(place.astype(U64) + U64(7))), dtype=U64)])
    fixed = np.concatenate([[0], np.cumsum(tokens != U64(1))])
    full = (lengths >= least_tokens) & (fixed[offsets[1:]] > fixed[offsets[:-1]])
    start, n = offsets[:-1][full], lengths[full]
    head = total[start + np.minimum(n, depth)] - total[start]
    row, number = row[full], number[full]
    raw = memoryview((tokens >> U64(48)).astype("<u2").tobytes())
    first = np.flatnonzero(np.diff(row, prepend=-1))
    sign = np.full(len(row), None, object)
    if len(first):
        ends, rolled = windows(tokens, offsets[np.concatenate([[0], np.cumsum(per)])], SHINGLE)
        kept = np.repeat(np.isin(np.arange(len(texts)), row[first]), np.diff(ends))
        signs = text_signatures(rolled[kept], np.concatenate([[0], np.cumsum(np.diff(ends)[row[first]])]))
        sign[first] = [s.tobytes() for s in signs]
    return {
        "row": row,
        "line_no": number.astype(np.int32),
        "n": n.astype(np.int32),
        "leaf": mix(head + n.astype(U64) * _GOLD).view(np.int64),
        "line": mix(total[start + n] - total[start] + n.astype(U64)).view(np.int64),
        "tokens": np.array([bytes(raw[2 * a : 2 * b]) for a, b in zip(start.tolist(), (start + n).tolist(), strict=True)], object),
        "sign": sign,
    }


class Leaves:
    """Lines (``leaf``, and ``tokens[offsets[i]:offsets[i + 1]]``) of whatever leaves, any two of one leaf of equally many tokens."""

    def __init__(self, leaf: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, similarity: float = SIMILARITY):
        self.leaf, self.tokens, self.start, self.n = leaf, tokens, offsets[:-1], np.diff(offsets)
        self.lead = np.minimum(self.n, depth)
        #: Unlike tokens that two lines of a template may have.
        self.allowed = ((1 - similarity) * self.n + 1e-9).astype(np.int64)

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch, depth: int, similarity: float) -> Leaves:
        raw = rows["tokens"].to_pylist()
        return cls(rows["leaf"].to_numpy(), np.frombuffer(b"".join(raw), "<u2"), np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int64), depth, similarity)

    def chunk_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines, keys): for each chunk of each line its key. Lines of a leaf that are similar enough have one in common."""
        rest = self.n - self.lead
        any_two = self.allowed >= rest
        chunks = np.where(any_two, 1, self.allowed + 1)
        place = np.arange(len(self.tokens)) - np.repeat(self.start, self.n)
        total = np.concatenate([[U64(0)], np.cumsum(mix(self.tokens.astype(U64) + mix(place.astype(U64) + U64(7))), dtype=U64)])
        line = np.repeat(np.arange(len(self.leaf)), chunks)
        k = np.arange(len(line)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = self.start[line] + self.lead[line]
        a = first + rest[line] * k // chunks[line]
        b = np.where(any_two[line], a, first + rest[line] * (k + 1) // chunks[line])
        return line, mix(mix(self.leaf[line].view(U64) + k.astype(U64) + U64(1)) * _GOLD + (total[b] - total[a]))

    def similar(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether lines ``u[i]`` and ``v[i]`` of one leaf have few enough unlike tokens."""
        if not len(u):
            return np.zeros(0, bool)
        n = self.n[u]
        unlike = self.tokens[ranges(self.start[u], n)] != self.tokens[ranges(self.start[v], n)]
        return np.add.reduceat(unlike.astype(np.int64), np.cumsum(n) - n) <= self.allowed[u]

    def near(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = self.leaf[u] == self.leaf[v]
        out[out] = self.similar(u[out], v[out])
        return out

    def templates(self) -> np.ndarray:
        """The template of each line, as the number of its first one: the connected lines of a leaf, similar ones being linked."""
        line, key = self.chunk_keys()
        order = np.argsort(key, kind="stable")
        key, line = key[order], line[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        u, v = links_in_groups(starts, len(key), lambda a, b: self.near(line[a], line[b]))
        return connected(len(self.leaf), line[u], line[v])


def live_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, thinned): the leaves that two different texts or more reach, and ``lines`` without most of those in other leaves."""
    live = checkpointed(lines.groupBy("leaf").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a != b").select("leaf"))
    maybe = RowFilter(live, "leaf")

    @F.arrow_udf("boolean")
    def may_be_live(leaf: pa.Array) -> pa.Array:
        return pa.array(maybe(leaf.to_numpy(zero_copy_only=False)))

    return live, lines.where(may_be_live("leaf"))


def assign_templates(live: DataFrame, lines: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(leaf, line, template) for the lines in ``live`` leaves; a template is known by one of its lines.

    Equal lines meet as one row before a leaf is formed, so a leaf's size is that of its variety.
    """
    some = lines.select("leaf", "line", "n", "tokens").distinct()
    sizes = live.join(some.groupBy("leaf").agg(F.count("*").alias("size")), "leaf")
    told = checkpointed(some.join(sizes, "leaf"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in whole_groups(batches, ["leaf"]):
            line = g["line"].to_numpy()
            yield pa.RecordBatch.from_arrays([g["leaf"].combine_chunks(), pa.array(line), pa.array(line[Leaves.of(g, depth, similarity).templates()])], ["leaf", "line", "template"])

    small = told.where(F.col("size") <= leaf_lines).repartition("leaf").sortWithinPartitions("leaf", "line")
    named = small.mapInArrow(within, "leaf long, line long, template long")
    large = told.where(F.col("size") > leaf_lines)
    if large.isEmpty():
        return named

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, key = Leaves.of(b, depth, similarity).chunk_keys()
                yield from pa.Table.from_batches([b.select(["leaf", "line", "tokens"])]).take(pa.array(at)).append_column("key", pa.array(key.view(np.int64))).to_batches()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts in whole_groups(batches, ["leaf", "key", "__i", "__j"]):
            line = g["line"].to_numpy()
            u, v = links_in_groups(starts, len(line), Leaves.of(g, depth, similarity).near, g["__side"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(line[u]), pa.array(line[v])], ["u", "v"])

    keyed = checkpointed(large.mapInArrow(keys, "leaf long, line long, tokens binary, key long"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = _blocks(keyed.join(shared, "key"), "line", F.col("size"), leaf_lines)
    edges = dealt.repartition("leaf", "key", "__i", "__j").sortWithinPartitions("leaf", "key", "__i", "__j", "line").mapInArrow(across, "u long, v long")
    roots = components(edges.distinct()).select(F.col("node").alias("line"), F.col("component").alias("template"))
    return named.unionByName(large.select("leaf", "line").join(roots, "line", "left").select("leaf", "line", F.coalesce("template", "line").alias("template")))


def copy_classes(signed: DataFrame) -> DataFrame:
    """(id, class) of the texts of ``signed`` (id, sign) that have a near copy among them: the smallest id reachable by links.

    Texts meet in the buckets of their bands; in each a spanning forest of the links is kept. Large buckets are split in pairs of blocks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column("sign").to_pylist()), "<u2").reshape(b.num_rows, -1).astype(U64)
                for i in range(BANDS):
                    h = np.full(len(s), U64(i + 1))
                    for j in range(i * BAND, (i + 1) * BAND):
                        h = mix(h * _GOLD + s[:, j] + U64(1))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("id")], ["key", "id"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts in whole_groups(batches, ["key", "__i", "__j"]):
            ids = g["id"].to_numpy()
            s = np.frombuffer(b"".join(g["sign"].to_pylist()), "<u2").reshape(len(ids), -1)
            u, v = links_in_groups(starts, len(ids), lambda a, b, s=s: (s[a] == s[b]).sum(axis=1) >= AGREE, g["__side"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    keyed = checkpointed(signed.mapInArrow(keys, "key long, id long"))
    live = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = _blocks(keyed.join(live, "key"), "id", F.col("size"), CLASS_BLOCK).join(signed, "id")
    by_bucket = members.select("key", "__i", "__j", "__side", "id", "sign").repartition("key", "__i", "__j").sortWithinPartitions("key", "__i", "__j", "id")
    return components(by_bucket.mapInArrow(link, "u long, v long").distinct()).select(F.col("node").alias("id"), F.col("component").alias("class"))


def recurring(df: DataFrame, text: str = "text", least_tokens: int = LEAST_TOKENS, depth: int = DEPTH, similarity: float = SIMILARITY, least_documents: int = LEAST_DOCUMENTS, leaf_lines: int = LEAF_LINES) -> tuple[DataFrame, DataFrame]:
    """(occurrences, templates): (k1, k2, line_no, line, template) for lines of texts that other texts may hold too, and the (template) that recur."""
    names = ["k1", "k2", "line_no", "n", "leaf", "line", "tokens", "sign"]
    kinds = "k1 long, k2 long, line_no int, n int, leaf long, line long, tokens binary, sign binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            _, first = np.unique(b.column("k1").to_numpy(), return_index=True)
            b = b.take(pa.array(np.sort(first)))  # equal texts give equal lines
            t = line_templates(b.column("text"), depth, least_tokens)
            columns = [b.column(k).to_numpy()[t["row"]] for k in ("k1", "k2")] + [t[c] for c in names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if n in ("tokens", "sign") else pa.array(c) for n, c in zip(names, columns, strict=True)], names)

    texts = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), F.col(text).cast("string").alias("text"))
    # Read several times, a few columns each.
    lines = stored(texts.mapInArrow(parse, kinds))
    live, thinned = live_lines(lines)
    named = assign_templates(live, thinned, depth, similarity, leaf_lines)
    hits = stored(thinned.select("k1", "k2", "line_no", "leaf", "line").join(named, ["leaf", "line"]).drop("leaf"))
    held = hits.groupBy("template").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a != b").select("template")
    holders = stored(hits.select("template", F.col("k1").alias("id")).distinct().join(held, "template"))
    signed = lines.where("sign is not null").select(F.col("k1").alias("id"), "sign").dropDuplicates(["id"])
    # Written, so that a text with very many lines can be split where it is joined.
    classes = checkpointed(copy_classes(checkpointed(signed.join(holders.select("id").distinct(), "id"))))
    of_class = holders.join(classes, "id", "left").select("template", F.coalesce("class", "id").alias("class"))
    counts = of_class.groupBy("template").agg(F.count_distinct("class").alias("c"), F.count("*").alias("t"))
    return hits, counts.where((F.col("c") >= least_documents) & (F.col("c") * TEXTS_A_CLASS > F.col("t"))).select("template")


def drop_recurring_lines(
    df: DataFrame,
    text: str = "text",
    least_tokens: int = LEAST_TOKENS,
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    least_documents: int = LEAST_DOCUMENTS,
    leaf_lines: int = LEAF_LINES,
) -> DataFrame:
    """``df`` with recurring lines taken out of ``text``, and ``n_lines`` (of the old text) and ``dropped`` (their numbers, from 0, ascending).

    Dropped: lines of at least ``least_tokens`` tokens, not all variable, whose template is held by texts of ``least_documents`` classes of near copies
    or more, and more than one for each ``TEXTS_A_CLASS`` texts. Every occurrence goes, however long the text; other lines stay as they are, blank
    ones too. Null text stays null and has no lines; an empty one has one line. Repeated rows get the same result, an empty table gives an empty
    one, and older columns of the two names are replaced. Decisions hang on a text's content alone, so they are
    joined to the rows by its hash and a text is moved once, if it has any.
    """
    df = without(df, "n_lines", "dropped")
    hits, again = recurring(df, text, least_tokens, depth, similarity, least_documents, leaf_lines)
    keyed = df.withColumn("__k1", F.xxhash64(text)).withColumn("__k2", F.xxhash64(text, F.lit(1)))
    # A template may be in a third of all texts: its occurrences are dealt by their text as well.
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = hits.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["template", "salt"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line_no")).alias("__d"))
    # Written, so that the join to the texts has an exchange on either side and a text of which there are very many can be split.
    drops = checkpointed(drops)
    chosen = RowFilter(drops, "k1")

    @F.arrow_udf("boolean")
    def may_have_drops(k1: pa.Array) -> pa.Array:
        return pa.array(chosen(k1.to_numpy(zero_copy_only=False)))

    # Most texts hold no recurring line: they aren't moved. xxhash64 of null is its seed, so no key is null.
    keyed = keyed.withColumn("__may", may_have_drops("__k1"))
    moved = keyed.where("__may").join(drops, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left").drop("k1", "k2")
    joined = keyed.where("not __may").withColumn("__d", F.lit(None).cast("array<int>")).unionByName(moved)
    parts = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("__d", i)), "\n")
    columns = [F.when(F.col("__d").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in df.columns]
    return joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce("__d", F.array().cast("array<int>")).alias("dropped"))


def op9_line_dedup(documents: DataFrame) -> DataFrame:
    """Every document's text without recurring lines."""
    out = drop_recurring_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))
