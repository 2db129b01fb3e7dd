"""The queries over the driver's tables, and SQL for those that SQL can express.

Reads are the documents' letters as bases, whole; barcodes follow from the data's own
frequency window.  Intermediate tables that several queries need are recomputed by each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences
from .functions.ordering import spread
from .functions.storage import plan_bytes, written
from .operators import barcodes as B
from .operators import binning, cover, kmers, overlap, paths, selection, spectrum
from .sources import adapters, readers, writers

#: Parameters of the queries; SQL is filled in from the same values.
P = {"k": 21, "key": 11, "stride": 3, "fraction": 0.25, "cap": 4000, "min_overlap": 10, "depth": 4, "top": 10, "genome": 600_000, "coverage": 3.0}
CAP_PATHS = 5
#: Letters that one query does not map to bases.
MASKED = "qv"
MIN_BASES = sequences.min_bin_bases(P["genome"], P["coverage"])
KEYS = {"k": P["key"], "fraction": P["fraction"], "cap": P["cap"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.reads_from_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def kept(spark: SparkSession, sf_dir: str, masked: str = "") -> DataFrame:
    return adapters.kept_reads(table(spark, sf_dir, "documents").select("doc_id", "text"), masked)


def counts(spark, sf_dir, every: DataFrame | None = None):
    """For spectra: the rare k-mers, which no window holds, are counted without their codes."""
    every = kept(spark, sf_dir) if every is None else every
    return kmers.code_counts(every, P["k"], least=spectrum.LEAST_LOWER, size=plan_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")))


def windowed_unikmers(spark, sf_dir, every: DataFrame | None = None):
    n = written(counts(spark, sf_dir, every), "counts")
    lower, upper = spectrum.window_bounds(kmers.kmer_histogram(n))
    return spectrum.unikmers(n, lower, upper)


def barcoded(spark, sf_dir) -> DataFrame:
    """Barcodes of all reads, computed once for a query that uses them several times."""
    every = kept(spark, sf_dir)
    return written(B.barcodes(every, windowed_unikmers(spark, sf_dir, every), P["k"]), "barcodes")


def q_kmer_histogram(spark, sf_dir):
    return kmers.kmer_histogram(counts(spark, sf_dir))


def q_kmer_counts(spark, sf_dir):
    return kmers.kmer_counts(kept(spark, sf_dir), P["k"])


def q_masked_kmer_histogram(spark, sf_dir):
    """Two letters are no bases: windows that hold them are none."""
    return kmers.kmer_histogram(counts(spark, sf_dir, kept(spark, sf_dir, MASKED)))


def _records(spark, sf_dir) -> DataFrame:
    """Records named by the source of their document, so that names repeat."""
    docs = table(spark, sf_dir, "documents")
    return adapters.reads_from_documents(docs).drop("read_id", "read_int").join(docs.select(F.coalesce("source", F.lit("")).alias("read_id"), F.col("doc_id").alias("file_ord")), "file_ord")


def q_read_ints(spark, sf_dir):
    return readers.with_read_ints(_records(spark, sf_dir)).select("read_id", "file_ord", "read_int")


def q_last_records(spark, sf_dir):
    return readers.last_records(_records(spark, sf_dir)).select("read_id", "file_ord", "read_len")


def q_read_stats(spark, sf_dir):
    return B.read_stats(barcoded(spark, sf_dir))


def q_freq_window(spark, sf_dir):
    w = spectrum.frequency_window(written(kmers.kmer_histogram(counts(spark, sf_dir)), "histogram"))
    return w.select("start_idx", "peak_idx", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "lower", "upper")


def q_unikmers(spark, sf_dir):
    marks = windowed_unikmers(spark, sf_dir).select(kmers.decoded(F.col("code"), P["k"]).alias("kmer"), "unikmer_id")
    return marks.withColumn("code_prefix", sequences.encode2bit(F.substring("kmer", 1, 15)))


def _listed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


def q_read_barcodes(spark, sf_dir):
    return _listed(barcoded(spark, sf_dir).drop("read_int"), "barcode")


def q_barcode_distribution(spark, sf_dir):
    return binning.barcode_distribution(barcoded(spark, sf_dir))


def q_bin_bounds(spark, sf_dir):
    b = binning.bin_bounds(binning.barcode_distribution(barcoded(spark, sf_dir)))
    return b.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "lower", "upper", "adjusted")


def q_bin_rank(spark, sf_dir):
    return binning.bin_reads(barcoded(spark, sf_dir), P["genome"], P["coverage"])


def q_bin_summary(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    d = written(binning.barcode_distribution(b), "distribution")
    bounds = binning.bin_bounds(d)
    dim = binning.bin_dimension(d, bounds, binning.bin_starts(d, bounds, MIN_BASES), MIN_BASES)
    return binning.bin_summary(dim, binning.bin_reads(b, P["genome"], P["coverage"]))


def q_universe(spark, sf_dir):
    return cover.universe(barcoded(spark, sf_dir))


def q_universe_lineitem(spark, sf_dir):
    return cover.universe(adapters.barcodes_from_lineitem(table(spark, sf_dir, "lineitem")))


def q_champion_anchors(spark, sf_dir):
    return cover.champions(barcoded(spark, sf_dir)).select("read_id", "read_int", F.size("kept").alias("n_kept"), "read_len")


def q_cover_coverage(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return cover.coverage(cover.champions(b), cover.universe(b))


def q_anchors_lazy_greedy(spark, sf_dir):
    return _listed(cover.anchors(barcoded(spark, sf_dir)), "kept")


def q_anchors_by_rounds(spark, sf_dir):
    return _listed(cover.anchors_by_rounds(barcoded(spark, sf_dir)), "kept")


def q_greedy_coverage(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return cover.coverage(cover.anchors(b), cover.universe(b))


def q_direct_bridges(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return _listed(overlap.direct_bridges(b, cover.champions(b), P["min_overlap"]).drop("read_int"), "barcode")


def _index(b: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    return overlap.head_index(b, cover.champions(b) if chosen is None else chosen, stride=P["stride"], **KEYS)


def q_index_keys(spark, sf_dir):
    return _listed(_index(barcoded(spark, sf_dir)).drop("file_ord"), "key")


def q_posting_lists(spark, sf_dir):
    return _listed(_listed(overlap.posting_lists(_index(barcoded(spark, sf_dir))), "key"), "postings")


def q_index_statistics(spark, sf_dir):
    return overlap.index_statistics(_index(barcoded(spark, sf_dir)))


def q_index_keys_events(spark, sf_dir):
    return _listed(overlap.head_index(adapters.barcodes_from_events(table(spark, sf_dir, "events")), stride=P["stride"], **KEYS).drop("file_ord"), "key")


def q_overlap_edges(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    return overlap.overlap_edges(b, _index(b), **KEYS)


def _paths(b: DataFrame, chosen: DataFrame | None = None, **kw) -> DataFrame:
    chosen = written(cover.champions(b), "anchors") if chosen is None else chosen
    edges = written(overlap.overlap_edges(b, _index(b, chosen), **KEYS), "edges")
    return paths.top_paths(edges, chosen, max_depth=P["depth"] - 1, top_k=P["top"], **kw)


def q_paths_topk(spark, sf_dir):
    return _listed(_paths(barcoded(spark, sf_dir)), "path")


def q_paths_capped(spark, sf_dir):
    return _listed(_paths(barcoded(spark, sf_dir), max_expansions=CAP_PATHS), "path")


def q_bins_selected(spark, sf_dir):
    return selection.binned_reads(binning.bin_reads(barcoded(spark, sf_dir), P["genome"], P["coverage"]))


def q_final_selection(spark, sf_dir):
    b = barcoded(spark, sf_dir)
    chosen = cover.champions(b)
    bridged = paths.bridges(_paths(b), chosen, b)
    direct = overlap.direct_bridges(b, chosen, P["min_overlap"])
    return selection.final_selection(chosen, bridged, direct, binning.bin_reads(b, P["genome"], P["coverage"]))


def _chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Barcodes and the lazy greedy anchors, with the ids that each of them newly covers: the program's own chain."""
    b = barcoded(spark, sf_dir)
    return b, written(cover.anchors(b), "anchors")


def q_chain_direct_bridges(spark, sf_dir):
    b, chosen = _chain(spark, sf_dir)
    return _listed(overlap.direct_bridges(b, chosen, P["min_overlap"]).drop("read_int"), "barcode")


def q_chain_index_statistics(spark, sf_dir):
    return overlap.index_statistics(_index(*_chain(spark, sf_dir)))


def q_chain_paths(spark, sf_dir):
    return _listed(_paths(*_chain(spark, sf_dir)), "path")


def q_chain_read_counters(spark, sf_dir):
    b, chosen = _chain(spark, sf_dir)
    return overlap.read_counters(b.where("n_barcodes <> 1"), _index(b, chosen), b)


def q_chain_selection(spark, sf_dir):
    b, chosen = _chain(spark, sf_dir)
    direct = overlap.direct_bridges(b, chosen, P["min_overlap"])
    return selection.final_selection(chosen, paths.bridges(_paths(b, chosen), chosen, b), direct, binning.bin_reads(b, P["genome"], P["coverage"]))


def q_chain_path_statistics(spark, sf_dir):
    b, chosen = _chain(spark, sf_dir)
    return paths.path_statistics(_paths(b, chosen), chosen)


def q_selected_fasta(spark, sf_dir):
    """The records of direct bridges and their anchors as they are written."""
    b, chosen = _chain(spark, sf_dir)
    ids = overlap.direct_bridges(b, chosen, P["min_overlap"]).select("read_id").union(chosen.select("read_id"))
    return writers.fasta_lines(selection.selected_records(reads(spark, sf_dir), ids))


def q_anchor_fingerprint(spark, sf_dir):
    ids = cover.champions(barcoded(spark, sf_dir)).agg(F.array_sort(F.collect_list("read_int")).alias("ids"))
    return ids.select(F.size("ids").cast("bigint").alias("n"), sequences.fingerprint(F.col("ids")).alias("fingerprint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


_READS = """reads AS (SELECT doc_id AS read_int, CAST(doc_id AS VARCHAR) AS read_id,
  translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
_KMERS = """hits AS (SELECT read_int, i - 1 AS pos, substring(seq, i, {k}) AS f FROM (SELECT read_int, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads WHERE length(seq) >= {k})),
kmers AS (SELECT read_int, pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM hits),
counts AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer),
histo AS (SELECT n AS freq, count(*) AS n_kmers FROM counts GROUP BY n)"""
_WINDOW = """idx AS (SELECT freq, n_kmers, row_number() OVER (ORDER BY freq) - 1 AS idx, lead(n_kmers) OVER (ORDER BY freq) AS nx FROM histo),
st AS (SELECT min(idx) AS s FROM idx WHERE CAST(n_kmers AS DOUBLE) / nx <= 1.25),
pk AS (SELECT min(idx) AS p FROM idx, st WHERE n_kmers = (SELECT max(n_kmers) FROM idx, st WHERE idx >= s)),
win AS (SELECT freq, n_kmers FROM idx, st, pk WHERE idx BETWEEN s AND s + 2 * (p - s)),
mu AS (SELECT sum(CAST(freq AS DOUBLE) * n_kmers) / sum(CAST(n_kmers AS DOUBLE)) AS m FROM win),
sd AS (SELECT sqrt(sum(n_kmers * (freq - m) * (freq - m)) / sum(CAST(n_kmers AS DOUBLE))) AS d FROM win, mu),
bounds AS (SELECT CAST(greatest(floor(m - 3 * d), 5) AS BIGINT) AS lo, CAST(ceil(m + 3 * d) AS BIGINT) AS hi FROM mu, sd),
unik AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS uid FROM counts, bounds WHERE n BETWEEN lo AND hi)"""
_BARCODES = """bl AS (SELECT read_int, list(uid ORDER BY pos) AS b FROM kmers JOIN unik USING (kmer) GROUP BY read_int),
bc AS (SELECT read_id, read_int, length(seq) AS read_len, coalesce(b, []) AS b, coalesce(len(b), 0) AS n FROM reads LEFT JOIN bl USING (read_int))"""
_CHAMP = """held AS (SELECT DISTINCT read_int, n, u FROM (SELECT read_int, n, unnest(b) AS u FROM bc)),
champ AS (SELECT DISTINCT read_int FROM (SELECT read_int, row_number() OVER (PARTITION BY u ORDER BY n DESC, read_int) AS r FROM held) WHERE r = 1),
ch AS (SELECT bc.* FROM bc JOIN champ USING (read_int))"""
_DIST = """dist AS (SELECT n, count(*) AS n_reads, sum(read_len) AS sum_bases FROM bc GROUP BY n),
bmu AS (SELECT sum(CAST(n AS DOUBLE) * n_reads) / sum(CAST(n_reads AS DOUBLE)) AS m FROM dist WHERE n >= 50),
bsd AS (SELECT sqrt(sum(n_reads * (n - m) * (n - m)) / sum(CAST(n_reads AS DOUBLE))) AS d FROM dist, bmu WHERE n >= 50),
bb AS (SELECT m, d, CAST(greatest(floor(m - 3 * d), 50) AS BIGINT) AS lo, CAST(ceil(m + 3 * d) AS BIGINT) AS hi, CAST(round_even(ceil(m + 3 * d) / 500.0, 0) * 500 AS BIGINT) AS adj FROM bmu, bsd)"""
_BINS = """seqd AS (SELECT n, sum_bases, row_number() OVER (ORDER BY n) AS rn FROM dist, bb WHERE n > 5 AND n <= adj),
fold AS (SELECT rn, n, n AS ws, sum_bases AS acc FROM seqd WHERE rn = 1
  UNION ALL SELECT s.rn, s.n, CASE WHEN f.acc >= {min_bases} THEN s.n ELSE f.ws END, CASE WHEN f.acc >= {min_bases} THEN s.sum_bases ELSE f.acc + s.sum_bases END FROM fold f JOIN seqd s ON s.rn = f.rn + 1),
binned AS (SELECT CASE WHEN n <= 5 THEN n WHEN n > adj THEN adj + 1 ELSE (SELECT ws FROM fold WHERE fold.n = bc.n) END AS bin_id, read_id, read_int, read_len FROM bc, bb)"""
_INDEX = """starts AS (SELECT read_int, b, n, least(CAST(floor(n * 0.25) AS BIGINT), {cap}) AS w, read_int IN (SELECT read_int FROM champ) AS every FROM bc WHERE n > 0),
idxk AS (SELECT read_int, st AS start, list_slice(b, st + 1, st + {key}) AS key FROM (
  SELECT read_int, b, unnest(CASE WHEN every THEN range(0, n - {key} + 1) WHEN w >= {key} THEN list_distinct(list_concat(range(0, w - {key} + 1, {stride}), range(n - w, n - {key} + 1, {stride}))) ELSE [] END) AS st FROM starts))"""
_EDGES = """tail AS (SELECT DISTINCT read_int AS src, list_slice(b, st + 1, st + {key}) AS key FROM (SELECT read_int, b, unnest(CASE WHEN w >= {key} THEN range(n - w, n - {key} + 1) ELSE [] END) AS st FROM starts)),
edges AS (SELECT DISTINCT src, read_int AS dst FROM tail JOIN idxk USING (key))"""
_PATHS = """p AS (SELECT read_int AS source, [read_int] AS path, 1 AS d FROM champ
  UNION ALL SELECT source, list_append(path, dst), d + 1 FROM p JOIN edges ON src = path[-1] WHERE d < {depth} AND NOT list_contains(path, dst)),
ranked AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY d DESC, path) AS rank FROM p WHERE d > 1 AND path[-1] IN (SELECT read_int FROM champ)),
top AS (SELECT * FROM ranked WHERE rank <= {top})"""
_DIRECT = """ap AS (SELECT b, n, unnest(range(0, n)) AS p FROM ch WHERE n >= {mo}),
cand AS (SELECT * FROM bc WHERE n >= {mo} AND read_int NOT IN (SELECT read_int FROM champ)),
pre AS (SELECT DISTINCT c.read_int FROM cand c JOIN ap a ON c.b[1] = a.b[a.p + 1] WHERE a.n - a.p >= {mo} AND c.n >= a.n - a.p AND list_slice(c.b, 1, a.n - a.p) = list_slice(a.b, a.p + 1, a.n)),
suf AS (SELECT DISTINCT c.read_int FROM cand c JOIN ap a ON c.b[-1] = a.b[a.p + 1] WHERE a.p + 1 >= {mo} AND c.n >= a.p + 1 AND list_slice(c.b, c.n - a.p, c.n) = list_slice(a.b, 1, a.p + 1)),
direct AS (SELECT c.* FROM cand c JOIN pre USING (read_int) JOIN suf USING (read_int))"""


#: The queue of the lazy greedy cover: the head gets its true score, or is taken if that reaches the next score.
_LAZY = """lazy(read_int, stale, rem, sel) USING KEY (read_int) AS (
  SELECT read_int, n AS stale, b AS rem, 0::BIGINT AS sel FROM bc WHERE n > 0
  UNION
  SELECT r.read_int, CASE WHEN r.read_int = h.read_int THEN len(r.rem) ELSE r.stale END,
    CASE WHEN r.read_int <> h.read_int AND h.picked THEN list_filter(r.rem, lambda x: NOT list_contains(h.rem, x)) ELSE r.rem END,
    CASE WHEN r.read_int = h.read_int AND h.picked THEN h.turn ELSE r.sel END
  FROM recurring.lazy r, (
    SELECT read_int, rem, len(rem) >= greatest(1, coalesce(nxt, 0)) AS picked, turn FROM (
      SELECT read_int, rem, lead(stale) OVER w AS nxt, row_number() OVER w AS rn, (SELECT 1 + max(sel) FROM recurring.lazy) AS turn
      FROM recurring.lazy WHERE sel = 0 AND stale > 0 WINDOW w AS (ORDER BY stale DESC, read_int)) WHERE rn = 1) h
  WHERE r.sel = 0 AND (r.read_int = h.read_int OR (h.picked AND list_has_any(r.rem, h.rem)))),
champ AS (SELECT read_int FROM lazy WHERE sel > 0),
ch AS (SELECT bc.read_id, bc.read_int, bc.read_len, rem AS b, len(rem) AS n, sel FROM lazy JOIN bc USING (read_int) WHERE sel > 0)"""
#: Rounds of the distributed cover: a read is taken if it is the best holder of each of its open ids.
_ROUNDS = """rounds(read_int, rem, sel, turn) USING KEY (read_int) AS (
  SELECT read_int, b AS rem, 0::BIGINT AS sel, 1::BIGINT AS turn FROM bc WHERE n > 0
  UNION
  SELECT r.read_int, CASE WHEN w.read_int IS NULL THEN list_filter(r.rem, lambda x: NOT list_contains(g.ids, x)) ELSE r.rem END,
    CASE WHEN w.read_int IS NULL THEN 0 ELSE r.turn END, r.turn + 1
  FROM recurring.rounds r LEFT JOIN {wins} w ON w.read_int = r.read_int, (SELECT list(DISTINCT id) AS ids FROM (SELECT unnest(rem) AS id FROM recurring.rounds WHERE read_int IN (SELECT read_int FROM {wins}))) g
  WHERE r.sel = 0 AND len(r.rem) > 0),
ranked AS (SELECT row_number() OVER (ORDER BY sel, len(rem) DESC, read_int) - 1 AS sel_ord, read_int, rem FROM rounds WHERE sel > 0)"""
_WINS = """(SELECT read_int FROM (SELECT read_int, row_number() OVER (PARTITION BY id ORDER BY s DESC, read_int) AS rn FROM (
    SELECT DISTINCT read_int, len(rem) AS s, id FROM (SELECT read_int, rem, unnest(rem) AS id FROM recurring.rounds WHERE sel = 0))) GROUP BY read_int HAVING max(rn) = 1)"""
#: Paths level by level, where a source takes its children in order up to the cap.
_CAPPED = """p AS (SELECT read_int AS source, [read_int] AS path, 1 AS d, 0::BIGINT AS used FROM champ
  UNION ALL SELECT source, path, d, used + kept FROM (
    SELECT source, path, d, used, nth, count(*) FILTER (used + nth <= {cap_paths}) OVER (PARTITION BY source) AS kept FROM (
      SELECT source, list_append(path, dst) AS path, d + 1 AS d, used, row_number() OVER (PARTITION BY source ORDER BY path, dst) AS nth
      FROM p JOIN edges ON src = path[-1] WHERE d < {depth} AND NOT list_contains(path, dst))) WHERE used + nth <= {cap_paths}),
ranked AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY d DESC, path) AS rank FROM p WHERE d > 1 AND path[-1] IN (SELECT read_int FROM champ)),
top AS (SELECT * FROM ranked WHERE rank <= {top})"""
_EVENTS = """coded AS (SELECT user_id, ts, event_id, md5(event_type || '/' || CAST(hour(ts) AS VARCHAR)) AS h FROM events),
bc AS (SELECT read_int, b, len(b) AS n FROM (SELECT user_id AS read_int, list(CAST(('0x' || h[1:8]) AS BIGINT) ORDER BY ts, event_id) AS b FROM coded GROUP BY user_id)),
champ AS (SELECT read_int FROM bc WHERE n < 0)"""


def _sql(*parts: str, select: str) -> str:
    text = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + select).replace("{wins}", _WINS)
    for name, value in {"k": P["k"], "key": P["key"], "stride": P["stride"], "cap": P["cap"], "mo": P["min_overlap"], "depth": P["depth"], "top": P["top"], "min_bases": MIN_BASES, "cap_paths": CAP_PATHS}.items():
        text = text.replace("{" + name + "}", str(value))
    return text


def code_counts_sql(prefix: int) -> str:
    """2-bit codes of all k-mers, their counts and first bases."""
    code = "CAST(list_sum(list_transform(range(1, {k} + 1), lambda i: CAST(instr('ACGT', kmer[i]) - 1 AS BIGINT) << (2 * ({k} - i)))) AS BIGINT)"
    return _sql(_READS, _KMERS, select=f"SELECT {code} AS code, n, substring(kmer, 1, {prefix}) AS prefix FROM counts".replace("{k}", str(P["k"])))


def chosen_reads_sql() -> str:
    """All reads with their bins, and whether the champions, the direct bridges or the first bins select them."""
    flags = "read_int IN (SELECT read_int FROM champ) AS is_anchor, read_int IN (SELECT read_int FROM direct) AS is_bridge"
    rows = f"SELECT *, {flags} FROM bc JOIN (SELECT read_int, CAST(bin_id AS BIGINT) AS bin_id, row_number() OVER (PARTITION BY bin_id ORDER BY read_len DESC, read_int) AS rank_in_bin FROM binned) USING (read_int)"
    return _sql(_READS, _KMERS, _WINDOW, _BARCODES, _CHAMP, _DIST, _BINS, _DIRECT, select=f"""SELECT read_id, read_int, CAST(read_len AS INTEGER) AS read_len, CAST(n AS INTEGER) AS n_barcodes, array_to_string(b, ',') AS barcode,
  rank_in_bin, is_anchor, is_bridge, is_anchor OR is_bridge OR bin_id BETWEEN 0 AND 200 AS selected, bin_id FROM ({rows})""")


def oracle_sql() -> dict[str, str]:
    hidden = _READS.replace("'ACGTACGTACGTACGTACGTACGTAC'", "'" + adapters.bases_without(MASKED) + "'"), _KMERS.replace("length(seq) >= {k})),", "length(seq) >= {k})\n  WHERE NOT contains(substring(seq, i, {k}), 'N')),")
    base, coded = (_READS, _KMERS), (_READS, _KMERS, _WINDOW, _BARCODES)
    champ, bins, lazy = (*coded, _CHAMP), (*coded, _DIST, _BINS), (*coded, _LAZY)
    selected = "SELECT read_id FROM ch UNION SELECT CAST(unnest(path) AS VARCHAR) FROM top UNION SELECT read_id FROM direct UNION SELECT read_id FROM binned WHERE bin_id BETWEEN 0 AND 200"
    counted = "SELECT count(DISTINCT key) AS unique_keys, count(*) AS postings, count(DISTINCT read_int) AS indexed_reads FROM idxk"
    join = lambda x: f"array_to_string({x}, ',')"
    return {
        "kmer_histogram": _sql(*base, select="SELECT freq, n_kmers FROM histo"),
        "masked_kmer_histogram": _sql(*hidden, select="SELECT freq, n_kmers FROM histo"),
        "read_ints": "SELECT coalesce(source, '') AS read_id, doc_id AS file_ord, dense_rank() OVER (ORDER BY f) - 1 AS read_int FROM (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(source, '')) AS f FROM documents)",
        "last_records": "SELECT coalesce(source, '') AS read_id, max(doc_id) AS file_ord, CAST(arg_max(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), doc_id) AS INTEGER) AS read_len FROM documents GROUP BY 1",
        "read_stats": _sql(*coded, select="SELECT read_id, CAST(n AS INTEGER) AS n_barcodes, CAST(read_len AS INTEGER) AS read_len FROM bc"),
        "chain_path_statistics": _sql(*lazy, _INDEX, _EDGES, _PATHS, select="SELECT (SELECT count(*) FROM champ) AS sources, count(DISTINCT source) AS with_paths, count(*) AS paths, CAST(max(len(path)) AS INTEGER) AS longest FROM top"),
        "selected_fasta": _sql(*lazy, _DIRECT, select="SELECT '>' || read_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM reads WHERE read_int IN (SELECT read_int FROM direct UNION SELECT read_int FROM champ)"),
        "kmer_counts": _sql(*base, select="SELECT kmer, n FROM counts"),
        "freq_window": _sql(*base, _WINDOW, select="SELECT s AS start_idx, p AS peak_idx, round(m, 6) AS mean, round(d, 6) AS std, lo AS lower, hi AS upper FROM st, pk, mu, sd, bounds"),
        "unikmers": _sql(*base, _WINDOW, select="SELECT kmer, uid AS unikmer_id, CAST(list_sum(list_transform(range(1, 16), lambda i: CAST(instr('ACGT', kmer[i]) - 1 AS BIGINT) * CAST(pow(4, 15 - i) AS BIGINT))) AS BIGINT) AS code_prefix FROM unik"),
        "read_barcodes": _sql(*coded, select=f"SELECT read_id, CAST(read_len AS INTEGER) AS read_len, {join('b')} AS barcode, CAST(n AS INTEGER) AS n_barcodes FROM bc"),
        "barcode_distribution": _sql(*coded, _DIST, select="SELECT CAST(n AS INTEGER) AS n_barcodes, n_reads, CAST(sum_bases AS BIGINT) AS sum_bases FROM dist"),
        "bin_bounds": _sql(*coded, _DIST, select="SELECT round(m, 6) AS mean, round(d, 6) AS std, lo AS lower, hi AS upper, adj AS adjusted FROM bb"),
        "bin_rank": _sql(*bins, select="SELECT CAST(bin_id AS BIGINT) AS bin_id, read_id, CAST(read_len AS INTEGER) AS read_len, row_number() OVER (PARTITION BY bin_id ORDER BY read_len DESC, read_int) AS rank_in_bin FROM binned"),
        "bin_summary": _sql(*bins, _PHANTOM, select="SELECT CAST(i.bin_id AS BIGINT) AS bin_id, count(read_id) AS n_reads, CAST(coalesce(sum(read_len), 0) AS BIGINT) AS sum_bases FROM ids i LEFT JOIN binned USING (bin_id) GROUP BY i.bin_id"),
        "universe": _sql(*coded, select="SELECT DISTINCT unnest(b) AS unikmer_id FROM bc"),
        "universe_lineitem": "SELECT DISTINCT l_partkey AS unikmer_id FROM lineitem",
        "champion_anchors": _sql(*champ, select="SELECT read_id, read_int, CAST(n AS INTEGER) AS n_kept, CAST(read_len AS INTEGER) AS read_len FROM ch"),
        "cover_coverage": _sql(*champ, select="SELECT (SELECT count(*) FROM champ) AS n_anchors, covered, universe_size, round(100.0::DOUBLE * covered / universe_size, 6) AS pct FROM (SELECT count(DISTINCT u) FILTER (WHERE read_int IN (SELECT read_int FROM champ)) AS covered, count(DISTINCT u) AS universe_size FROM held)"),
        "anchors_lazy_greedy": _sql(*lazy, select=f"SELECT CAST(sel - 1 AS INTEGER) AS sel_ord, read_id, read_int, {join('b')} AS kept, CAST(read_len AS INTEGER) AS read_len FROM ch"),
        "anchors_by_rounds": _sql(*coded, _ROUNDS, select=f"SELECT CAST(sel_ord AS INTEGER) AS sel_ord, read_id, read_int, {join('rem')} AS kept, CAST(read_len AS INTEGER) AS read_len FROM ranked JOIN bc USING (read_int)"),
        "greedy_coverage": _sql(*lazy, select="SELECT n_anchors, covered, universe_size, round(100.0::DOUBLE * covered / universe_size, 6) AS pct FROM (SELECT count(*) AS n_anchors FROM ch), (SELECT count(DISTINCT u) AS covered FROM (SELECT unnest(b) AS u FROM ch)), (SELECT count(DISTINCT u) AS universe_size FROM (SELECT unnest(b) AS u FROM bc))"),
        "chain_direct_bridges": _sql(*lazy, _DIRECT, select=f"SELECT read_id, {join('b')} AS barcode, CAST(read_len AS INTEGER) AS read_len FROM direct"),
        "chain_index_statistics": _sql(*lazy, _INDEX, select=counted),
        "chain_read_counters": _sql(*lazy, _INDEX, select="SELECT count(*) AS reads, count(*) FILTER (n = 1) AS missing, count(*) FILTER (n = 0) AS empty, count(*) FILTER (indexed) AS indexed, count(*) FILTER (n > 1 AND NOT indexed) AS unindexed FROM (SELECT n, read_int IN (SELECT read_int FROM idxk) AS indexed FROM bc)"),
        "chain_paths": _sql(*lazy, _INDEX, _EDGES, _PATHS, select=f"SELECT source, CAST(rank AS INTEGER) AS rank, {join('path')} AS path FROM top"),
        "chain_selection": _sql(*lazy, _DIST, _BINS, _INDEX, _EDGES, _PATHS, _DIRECT, select=selected),
        "index_keys_events": _sql(_EVENTS, _INDEX, select=f"SELECT {join('key')} AS key, read_int, CAST(start AS INTEGER) AS start FROM idxk"),
        "paths_capped": _sql(*champ, _INDEX, _EDGES, _CAPPED, select=f"SELECT source, CAST(rank AS INTEGER) AS rank, {join('path')} AS path FROM top"),
        "direct_bridges": _sql(*champ, _DIRECT, select=f"SELECT read_id, {join('b')} AS barcode, CAST(read_len AS INTEGER) AS read_len FROM direct"),
        "index_keys": _sql(*champ, _INDEX, select=f"SELECT {join('key')} AS key, read_int, CAST(start AS INTEGER) AS start FROM idxk"),
        "posting_lists": _sql(*champ, _INDEX, select=f"SELECT {join('key')} AS key, array_to_string(list(read_int ORDER BY read_int, start), ',') AS postings FROM idxk GROUP BY idxk.key"),
        "index_statistics": _sql(*champ, _INDEX, select=counted),
        "overlap_edges": _sql(*champ, _INDEX, _EDGES, select="SELECT src, dst FROM edges"),
        "paths_topk": _sql(*champ, _INDEX, _EDGES, _PATHS, select=f"SELECT source, CAST(rank AS INTEGER) AS rank, {join('path')} AS path FROM top"),
        "bins_selected": _sql(*bins, select="SELECT DISTINCT read_id FROM binned WHERE bin_id BETWEEN 0 AND 200"),
        "final_selection": _sql(*champ, _DIST, _BINS, _INDEX, _EDGES, _PATHS, _DIRECT, select=selected),
        "anchor_fingerprint": _sql(*champ, select="SELECT count(*) AS n, sha256(unhex(printf('%016X', count(*)) || string_agg(printf('%016X', read_int), '' ORDER BY read_int))) AS fingerprint FROM champ"),
    }


_PHANTOM = """wins AS (SELECT ws, max(n) AS last_n, sum(sum_bases) AS acc FROM fold JOIN dist USING (n) GROUP BY ws),
ids AS (SELECT n AS bin_id FROM dist WHERE n <= 5 UNION SELECT ws FROM wins UNION SELECT min(n) FROM dist WHERE n > 5
  UNION SELECT (SELECT min(n) FROM dist WHERE n > last_n) FROM wins WHERE last_n = (SELECT max(last_n) FROM wins) AND acc >= {min_bases} AND EXISTS (SELECT 1 FROM dist WHERE n > last_n)
  UNION SELECT adj + 1 FROM bb)"""
