"""The registered queries in SQL, for an engine with md5, list functions and lambdas. Written apart from the DataFrame code."""

from __future__ import annotations

from strandloom.operators.flowcell import places
from strandloom.operators.fragmentation import break_probability
from strandloom.plans.queries import CELL, FRAGMENT, LEAST, MIXED, OLIGOS, PCR_BIAS, PCR_CYCLES, PCR_PERCENT, PPM, SAMPLES, SEED

TURN = "translate(reverse({0}), 'ACGT', 'TGCA')"


def u(step: str, *parts: str) -> str:
    """The uniform number of a key."""
    key = " || '|' || ".join([f"'{SEED}|{step}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


DIGEST = " || ".join(f"md5(doc_id::VARCHAR || '|{i}')" for i in range(8))
MOL = f"""mol AS (
  SELECT *, n + tail AS len, n::VARCHAR || 'M' || CASE WHEN tail > 0 THEN tail::VARCHAR || 'S' ELSE '' END AS source_cigar FROM (
    SELECT doc_id AS ordinal, doc_id::VARCHAR AS row_key, 'm' || doc_id::VARCHAR AS molecule_id, (doc_id % 2 + 1)::VARCHAR AS sample_id, (doc_id % 4)::INT AS packet_id,
      source AS transcript_id, lang AS source_chrom, doc_id * 1000 + 1 AS source_start, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '+' END AS source_strand,
      40 + n_chars % 217 AS n, doc_id % 120 AS tail,
      substr(translate({DIGEST}, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (40 + n_chars % 217)::INT) || repeat('A', (doc_id % 120)::INT) AS sequence
    FROM documents))"""


def q(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([MOL, *ctes]) + " " + body


GC = "((length({0}) - length(replace({0}, 'C', '')) + length({0}) - length(replace({0}, 'G', '')))::DOUBLE / length({0}))"
TAIL = "(length(sequence) - length(rtrim(sequence, 'A')))"
COUNTED = f"(CASE WHEN {TAIL} > 40 THEN {TAIL} ELSE 0 END)"
SIZE_P = "(CASE WHEN len < 60 OR len > 320 THEN 0.0 WHEN len BETWEEN 120 AND 260 THEN 1.0 WHEN len < 120 THEN (len - 60) / 60.0::DOUBLE ELSE (320 - len) / 60.0::DOUBLE END)"
SIZED = f"sized AS (SELECT * FROM mol WHERE {u('sizing', 'row_key')} < {SIZE_P})"
HIST = """every AS (SELECT packet_id, bin, total FROM (SELECT packet_id, count(*) AS total FROM g GROUP BY 1), (SELECT unnest(range(40))::INT AS bin)),
b AS (SELECT packet_id, least(39, floor(gc * 40))::INT AS bin, count(*) AS n FROM g GROUP BY 1, 2),
hist AS (SELECT packet_id, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE, 9) AS fraction FROM every LEFT JOIN b USING (packet_id, bin))"""
G_ALL = f"g AS (SELECT packet_id, {GC.format('sequence')} AS gc FROM mol)"
G_ALIGNED = f"g AS (SELECT packet_id, {GC.format('substr(sequence, 1, n::INT)')} AS gc FROM mol)"

P_BREAK = break_probability(FRAGMENT[0], FRAGMENT[1])
CUTS = f"""bonds AS (SELECT row_key, unnest(range(1, len)) AS i FROM {{0}}),
breaks AS (SELECT row_key, i FROM bonds WHERE {u('fragment', 'row_key', 'i')} < {P_BREAK!r}),
edges AS (SELECT row_key, i FROM breaks UNION ALL SELECT row_key, 0 FROM {{0}}),
pieces AS (SELECT row_key, i AS a, row_number() OVER (PARTITION BY row_key ORDER BY i) - 1 AS k, lead(i) OVER (PARTITION BY row_key ORDER BY i) AS b FROM edges),
frag AS (SELECT m.*, p.a, p.k, coalesce(p.b, m.len) AS b FROM pieces p JOIN {{0}} m USING (row_key))"""

WEIGHT = " * ".join(f"(CASE substr(w, {j + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {PPM[b][j]!r}::DOUBLE" for b in "ACGT") + " ELSE 0.0 END)" for j in range(6))


def primed(source: str, step: str, name: str, primes: str = "greatest(1.0, floor(length(sequence) * 50 / 1000.0 + 0.5))") -> str:
    """Site of the earliest prime, and the complement from there."""
    return f"""{name}_w AS (SELECT row_key, i, {WEIGHT} AS x FROM (SELECT row_key, i, substr(sequence, i::INT + 1, 6) AS w FROM (SELECT row_key, sequence, unnest(range(length(sequence) - 5)) AS i FROM {source} WHERE length(sequence) >= 6))),
{name}_c AS (SELECT row_key, i, sum(x) OVER (PARTITION BY row_key ORDER BY i ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (PARTITION BY row_key) AS total FROM {name}_w),
{name}_g AS (SELECT row_key, 1 - pow(1 - {u(step, 'row_key')}, 1.0 / {primes}) AS goal FROM {source}),
{name}_s AS (SELECT row_key, min(i) AS site FROM {name}_c JOIN {name}_g USING (row_key) WHERE c >= goal * total GROUP BY 1),
{name} AS (SELECT m.row_key || '.cdna' AS row_key, m.molecule_id || '.cdna' AS molecule_id, s.site + 1 AS start, {TURN.format('substr(m.sequence, s.site::INT + 1)')} AS sequence FROM {source} m JOIN {name}_s s USING (row_key))"""


OL = len(OLIGOS[0])
TURNED = [o[::-1].translate(str.maketrans("ACGT", "TGCA")) for o in OLIGOS]
SCORES = f"""sites AS (SELECT row_key, site, substr(sequence, site::INT + 1, {OL}) AS w FROM (SELECT row_key, sequence, unnest(range(len - {OL - 1})) AS site FROM mol)),
scores AS (SELECT row_key, site, {OL} - least({", ".join(f"hamming(w, '{o}')" for o in TURNED)}) AS score FROM sites),
fired AS (SELECT row_key, site FROM scores WHERE {u('ribozero', 'row_key', 'site')} < 0.99 * pow(score / {OL}.0::DOUBLE, 8.0))"""

SAMPLE_ROWS = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in SAMPLES)
SAMPLE = f"samples AS (SELECT * FROM (VALUES {SAMPLE_ROWS}) t(sample_id, pre_i5, i5, post_i5, pre_i7, i7, post_i7))"

RATE = f"greatest(0.0, least(1.0, {PCR_BIAS[0]} + {PCR_BIAS[1]} * (gc - 0.5) + ({PCR_BIAS[2]}) * (gc - 0.5) * (gc - 0.5)))"
PCR = f"""pm AS (SELECT *, {GC.format('sequence')} AS gc FROM mol),
gaps AS (SELECT row_key, 0 AS i, floor(ln(1 - {u('pcr_gap', 'row_key', '0')}) / ln(1 - {PCR_PERCENT / 100.0!r}::DOUBLE))::BIGINT AS leaf FROM pm UNION ALL SELECT row_key, i + 1, leaf + 1 + floor(ln(1 - {u('pcr_gap', 'row_key', 'i + 1')}) / ln(1 - {PCR_PERCENT / 100.0!r}::DOUBLE))::BIGINT FROM gaps WHERE leaf < {1 << PCR_CYCLES}),
leaves AS (SELECT row_key, molecule_id, leaf, {RATE} AS rate FROM pm JOIN gaps USING (row_key) WHERE leaf < {1 << PCR_CYCLES}),
events AS (SELECT row_key, leaf, rate, i, leaf % (1 << (i + 1)::INT) AS prefix FROM (SELECT *, unnest(range({PCR_CYCLES})) AS i FROM leaves)),
lost AS (SELECT DISTINCT row_key, leaf FROM events WHERE prefix >= (1 << i::INT) AND {u('pcr_copy', 'row_key', 'i', 'prefix')} >= rate),
kept AS (SELECT l.row_key || '.p' || l.leaf AS row_key, l.molecule_id || CASE WHEN l.leaf = 0 THEN '' ELSE '.' || l.leaf END AS molecule_id, l.molecule_id AS parent, l.leaf::INT AS leaf FROM leaves l ANTI JOIN lost USING (row_key, leaf))"""

RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, packet_id ORDER BY ordinal, row_key) AS rn, count(*) OVER (PARTITION BY sample_id, packet_id) AS cnt FROM mol)"


def lane(lanes: list[int]) -> str:
    k = len(lanes)
    return f"({lanes}::INT[])[(CASE WHEN cnt < {k} THEN rn % {k} ELSE least({k - 1}, rn // greatest(1, cnt // {k})) END)::INT + 1]"


def draw(name: str, span: tuple[int, int]) -> str:
    return f"({span[0]} + floor({u('flowcell', 'row_key', f'{chr(39)}{name}{chr(39)}')} * {span[1] - span[0] + 1}))::INT"


COORDS = f"{draw('tile', CELL.tile)} AS tile, {draw('x', CELL.x)} AS x, {draw('y', CELL.y)} AS y"
CALLED = """called AS (SELECT *, CASE WHEN ordinal % 17 = 0 THEN substr(wrong, 1, 9) ELSE wrong END AS called_barcode FROM (
  SELECT *, CASE WHEN ordinal % 4 >= 1 THEN 'N' ELSE substr(code, 1, 1) END || substr(code, 2, 8) || CASE WHEN ordinal % 4 >= 2 THEN 'N' ELSE substr(code, 10, 1) END || substr(code, 11, 6) AS wrong
  FROM (SELECT *, CASE WHEN sample_id = '1' THEN 'ACGTACGTTTGCAAGC' ELSE 'TGCATGCACCGATTAG' END AS code FROM mol)))"""
DEMUX = CALLED + """, demux AS (SELECT *, CASE WHEN length(called_barcode) = 16 AND hamming(padded, code) <= 1 THEN 'identified' ELSE 'unidentified' END AS status FROM (SELECT *, CASE WHEN length(called_barcode) = 16 THEN called_barcode ELSE repeat('-', 16) END AS padded FROM called))"""
PLACED = DEMUX + f""", placed AS (SELECT *, {lane([1, 2])} AS lane, {COORDS} FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, packet_id ORDER BY ordinal, row_key) AS rn, count(*) OVER (PARTITION BY sample_id, packet_id) AS cnt FROM demux)),
reads AS (SELECT *, 'LOOM:1:' || lane || ':' || tile || ':' || x || ':' || y || ':' || molecule_id AS name, d AS direction,
  CASE WHEN d = 1 THEN substr(sequence, 1, 40) ELSE {TURN.format('substr(sequence, (len - 39)::INT, 40)')} END AS bases,
  repeat(CASE WHEN d = 1 THEN chr((33 + least(41, ordinal % 50))::INT) ELSE 'J' END, 40) AS quality,
  CASE WHEN d = 1 THEN source_start ELSE source_start + len - 40 END AS pos,
  CASE WHEN d = 1 THEN source_strand WHEN source_strand = '-' THEN '+' ELSE '-' END AS strand FROM placed, (SELECT unnest([1, 2]) AS d))"""

ORACLE: dict[str, str] = {
    "quant_by_transcript": q("SELECT sample_id, packet_id, transcript_id, count(*) AS counts FROM mol GROUP BY ALL"),
    "quant_rollup": q("SELECT sample_id, transcript_id, count(*) AS counts FROM mol GROUP BY GROUPING SETS ((sample_id, transcript_id), (sample_id))"),
    "input_vs_output_quant": q("SELECT sample_id, transcript_id, coalesce(a.c, 0) AS input_counts, coalesce(b.c, 0) AS output_counts FROM (SELECT sample_id, transcript_id, count(*) AS c FROM mol GROUP BY ALL) a FULL JOIN (SELECT sample_id, transcript_id, count(*) AS c FROM sized GROUP BY ALL) b USING (sample_id, transcript_id)", SIZED),
    "gc_content": q(f"SELECT row_key, round({GC.format('sequence')}, 9) AS gc FROM mol"),
    "gc_aligned_only": q(f"SELECT row_key, round({GC.format('substr(sequence, 1, n::INT)')}, 9) AS gc FROM mol"),
    "gc_histogram": q("SELECT * FROM hist", G_ALL, HIST),
    "gc_histogram_aligned": q("SELECT * FROM hist", G_ALIGNED, HIST),
    "mean_gc_histogram": q("SELECT bin, round(avg(fraction), 9) AS fraction FROM hist GROUP BY 1", G_ALL, HIST),
    "reverse_complement": q(f"SELECT row_key, {TURN.format('sequence')} AS turned FROM mol"),
    "polya_tail": q(f"SELECT row_key, {TAIL} AS tail FROM mol"),
    "base_counts": q("SELECT row_key, " + ", ".join(f"length(sequence) - length(replace(sequence, '{b}', '')) AS n_{b.lower()}" for b in "ACGT") + " FROM mol"),
    "base_matrix": q("SELECT row_key, " + ", ".join(f"regexp_replace(regexp_replace(sequence, '[^{b}]', '0', 'g'), '{b}', '1', 'g') AS row_{b.lower()}" for b in "ACGT") + " FROM mol"),
    "kmer_windows": q("SELECT substr(sequence, i::INT, 6) AS kmer, count(*) AS n FROM (SELECT sequence, unnest(range(1, len - 4)) AS i FROM mol) GROUP BY 1"),
    "kmer_ppm_weight": q(f"SELECT row_key, count(*) AS sites, round(max(x), 12) AS best, round(sum(x), 9) AS total FROM (SELECT row_key, {WEIGHT} AS x FROM (SELECT row_key, substr(sequence, i::INT, 6) AS w FROM (SELECT row_key, sequence, unnest(range(1, len - 4)) AS i FROM mol))) GROUP BY 1"),
    "hamming_distance": q("SELECT row_key, hamming(substr(sequence, 1, 20), substr(sequence, 11, 20)) AS mismatches FROM mol"),
    "polya_select": q(f"SELECT row_key, sequence FROM mol WHERE {u('polya', 'row_key')} <= least(0.05::DOUBLE * {COUNTED}, 1.0)"),
    "polya_break": q(f"SELECT row_key, substr(sequence, first::INT) AS sequence, first AS start FROM (SELECT *, CASE WHEN b < len - {COUNTED} THEN len - {COUNTED} - b + 1 ELSE 1 END AS first FROM (SELECT *, greatest(1, ceil(ln(1 - {u('polya_break', 'row_key')}) / ln(1 - 0.02::DOUBLE)))::BIGINT AS b FROM mol))"),
    "size_probability": q(f"SELECT row_key, round({SIZE_P}, 9) AS p FROM mol"),
    "size_select": q("SELECT row_key, len AS size FROM sized", SIZED),
    "fragment_uniform": q("SELECT row_key || '.f' || k AS row_key, a + 1 AS start, substr(sequence, a::INT + 1, (b - a)::INT) AS sequence FROM frag WHERE b - a >= 20", CUTS.format("mol")),
    "fragment_min_size": q("SELECT transcript_id, count(*) AS pieces, sum(b - a)::BIGINT AS bases FROM frag WHERE b - a >= 60 GROUP BY 1", CUTS.format("mol")),
    "first_strand": q("SELECT row_key, molecule_id, start, sequence FROM fs", primed("mol", "first_strand", "fs")),
    "second_strand": q("SELECT row_key, start, sequence FROM ss", primed("mol", "first_strand", "fs"), primed("fs", "second_strand", "ss")),
    "perfect_priming": q(f"SELECT row_key || '.cdna' AS row_key, 1 AS start, '-' AS strand, {TURN.format('sequence')} AS sequence FROM mol WHERE len >= 6"),
    "ribozero_score": q("SELECT row_key, site, score FROM scores", SCORES),
    "ribozero_drop": q("SELECT row_key FROM mol ANTI JOIN fired USING (row_key)", SCORES),
    "ribozero_split": "WITH RECURSIVE " + MOL + ", " + SCORES + f""", cut AS (
  SELECT row_key, 0 AS a, (SELECT min(site) FROM fired f WHERE f.row_key = m.row_key) AS b, 0 AS k FROM mol m
  UNION ALL SELECT c.row_key, c.b + {OL}, (SELECT min(site) FROM fired f WHERE f.row_key = c.row_key AND f.site >= c.b + {OL}), c.k + 1 FROM cut c WHERE c.b IS NOT NULL)
SELECT row_key || '.r' || k AS row_key, a + 1 AS start, substr(sequence, a::INT + 1, (coalesce(b, len) - a)::INT) AS sequence FROM cut JOIN mol USING (row_key) WHERE coalesce(b, len) > a""",
    "adapter_ligate": q("SELECT row_key, five || sequence || three AS sequence, length(five) || 'S' || len || 'M' || length(three) || 'S' AS cigar FROM mol JOIN (SELECT sample_id, pre_i5 || i5 || post_i5 AS five, 'A' || pre_i7 || i7 || post_i7 AS three FROM samples) USING (sample_id)", SAMPLE),
    "adapter_pairs": "SELECT f.l AS label5, f.s AS adapter5, t.l AS label3, t.s AS adapter3, row_number() OVER (ORDER BY f.l, t.l) AS pair FROM (VALUES ('a', 'ACGTAC'), ('b', 'TTGGCC')) f(l, s), (VALUES ('c', 'GATTAC'), ('d', 'CCGGAA')) t(l, s)",
    "cigar_parse": q("SELECT row_key, 0 AS part, 'M' AS op, n AS n, 1 AS q, source_start AS r FROM mol UNION ALL SELECT row_key, 1, 'S', tail, n + 1, source_start + n FROM mol WHERE tail > 0"),
    "cigar_chain": q("SELECT row_key, source_start + 10 AS start, CASE WHEN n >= 40 THEN '30M' ELSE (n - 10)::VARCHAR || 'M' || (40 - n)::VARCHAR || 'S' END AS cigar, '+' AS strand FROM mol"),
    "pcr_gc_success": q(f"SELECT row_key, round({RATE}, 9) AS rate FROM (SELECT *, {GC.format('sequence')} AS gc FROM mol)"),
    "pcr_amplify": q("SELECT row_key, molecule_id, leaf FROM kept", PCR),
    "pcr_duplicate_histogram": q("SELECT copies, count(*) AS molecules FROM (SELECT parent, count(*) AS copies FROM kept GROUP BY 1) GROUP BY 1", PCR),
    "pcr_parent_by_name": q("SELECT copies, count(*) AS molecules FROM (SELECT regexp_replace(molecule_id, '\\.[^.]*$', '') AS p, count(*) AS copies FROM kept WHERE leaf > 0 GROUP BY 1) GROUP BY 1", PCR),
    "lane_assign": q(f"SELECT row_key, {lane([1, 3, 4])} AS lane, rn AS cluster_id FROM ranked", RANKED),
    "coords_random": q(f"SELECT row_key, {COORDS} FROM mol"),
    "cluster_sort": q(f"SELECT sample_id, packet_id, {COORDS}, row_key FROM mol"),
    "bridge_counts_exact": q("SELECT row_key, 1024 AS molecule_count, (length(sequence) - length(replace(sequence, 'A', ''))) * 1024 AS a, (length(sequence) - length(replace(sequence, 'C', ''))) * 1024 AS c FROM mol"),
    "demultiplex": q("SELECT row_key, called_barcode, status FROM demux", DEMUX),
    "unidentified_count": q("SELECT sample_id, status, count(*) AS n FROM demux GROUP BY ALL", DEMUX),
    "fastq_records": q("SELECT sample_id, lane, direction, status, '@' || name || chr(9) || direction || ':N:0:' || called_barcode || chr(10) || bases || chr(10) || '+' || chr(10) || quality AS record FROM reads", PLACED),
    "sam_records": q(f"SELECT sample_id, lane, status, name AS qname, 3 + CASE WHEN direction = 1 THEN 64 ELSE 128 END + CASE WHEN strand = '-' THEN 16 ELSE 32 END AS flag, source_chrom AS rname, pos, 255 AS mapq, '40M' AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen, CASE WHEN strand = '-' THEN {TURN.format('bases')} ELSE bases END AS seq, CASE WHEN strand = '-' THEN reverse(quality) ELSE quality END AS qual FROM reads", PLACED),
    "pileup_coverage": q("SELECT source_chrom, source_strand, pos, sum(d) OVER (PARTITION BY source_chrom, source_strand ORDER BY pos)::BIGINT AS depth FROM (SELECT source_chrom, source_strand, pos, sum(d) AS d FROM (SELECT source_chrom, source_strand, source_start AS pos, 1 AS d FROM mol UNION ALL SELECT source_chrom, source_strand, source_start + n, -1 FROM mol) GROUP BY ALL HAVING sum(d) <> 0)"),
    "step_summary": q("SELECT sample_id, count(*) AS molecules, round(count(DISTINCT molecule_id) / (SELECT count(DISTINCT molecule_id) FROM mol m WHERE m.sample_id = sized.sample_id)::DOUBLE, 9) AS represented, count(*) FILTER (len < 100) AS under_100, count(*) FILTER (len >= 100 AND len < 500) AS under_500, count(*) FILTER (len >= 500 AND len < 1000) AS under_1000, count(*) FILTER (len >= 1000) AS longer FROM sized GROUP BY sample_id", SIZED),
    "occurring_ids": q("SELECT row_key FROM mol SEMI JOIN (SELECT row_key FROM frag WHERE b - a >= 20) USING (row_key)", SIZED, CUTS.format("sized")),
    "packet_union": q("SELECT CASE WHEN packet_id < 2 THEN packet_id ELSE packet_id + 10 END AS packet_id, count(*) AS n FROM mol GROUP BY 1"),
    "missing_samples": q("SELECT DISTINCT sample_id FROM mol WHERE sample_id NOT IN (SELECT sample_id FROM samples WHERE sample_id = '1')", SAMPLE),
    "phred_codes": q("SELECT row_key, chr((33 + least(41, ordinal % 60))::INT) AS code, least(41, ordinal % 60) AS score FROM mol"),
    "molecule_file_packets": q("SELECT (ordinal % 3)::INT AS packet_id, count(*) AS n, sum(len)::BIGINT AS bases, count(DISTINCT transcript_id) AS transcripts FROM mol GROUP BY 1"),
    "molecules_from_distribution": q(f"SELECT transcript_id, count(*) AS n FROM (SELECT {u('distribution', 'i')} AS u FROM range(5000) r(i)) d JOIN (SELECT transcript_id, (c - w) / t AS low, c / t AS high FROM (SELECT transcript_id, w, sum(w) OVER (ORDER BY transcript_id)::DOUBLE AS c, sum(w) OVER ()::DOUBLE AS t FROM (SELECT transcript_id, count(*) AS w FROM mol GROUP BY 1))) c ON u >= low AND u < high GROUP BY 1"),
}
ORACLE["distribution_molecules"] = q(f"""SELECT '1-d-' || i AS row_key, (i // 500 + 4)::INT AS packet_id, transcript_id, sequence || repeat('A', add_) AS sequence, source_start,
  CASE WHEN source_strand = '-' THEN add_ || 'S' || len || 'M' ELSE len || 'M' || add_ || 'S' END AS source_cigar
  FROM (SELECT i, (50 + floor({u('tail', 'i')} * 201))::INT AS add_, {u('distribution', 'i')} AS x FROM range(2000) r(i)) d
  JOIN (SELECT transcript_id, (c - w) / t AS low, c / t AS high FROM (SELECT transcript_id, w, sum(w) OVER (ORDER BY transcript_id)::DOUBLE AS c, sum(w) OVER ()::DOUBLE AS t FROM (SELECT transcript_id, count(*) AS w FROM mol GROUP BY 1))) c ON x >= low AND x < high
  JOIN (SELECT * FROM mol QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY ordinal) = 1) USING (transcript_id)""")
ORACLE["fragment_beta_all_bonds"] = q("SELECT row_key || '.f' || i AS row_key, i + 1 AS start, substr(sequence, i::INT + 1, 1) AS sequence FROM (SELECT row_key, sequence, unnest(range(len)) AS i FROM mol)")
ORACLE["first_strand_every_prime"] = q("SELECT row_key, start, sequence FROM fs", primed("mol", "first_strand", "fs", "length(sequence)"))
ORACLE["pcr_substitutions"] = q("SELECT kept.row_key, len AS size, len || 'M' AS cigar FROM kept JOIN mol ON kept.parent = mol.molecule_id", PCR)
ORACLE["bridge_substitution_totals"] = q("SELECT row_key, len AS places FROM mol")
ORACLE["sbs_clean"] = q(f"SELECT row_key, d AS direction, i5 || i7 AS called_barcode, CASE WHEN d = 1 THEN substr(sequence, 1, 40) ELSE {TURN.format('substr(sequence, (len - 39)::INT, 40)')} END AS called_sequence FROM mol JOIN samples USING (sample_id), (SELECT unnest([1, 2]) AS d)", SAMPLE)
PREP_P = "(CASE WHEN n < 20 OR n > 400 THEN 0.0 WHEN n BETWEEN 30 AND 300 THEN 1.0 WHEN n < 30 THEN (n - 20) / 10.0::DOUBLE ELSE (400 - n) / 100.0::DOUBLE END)"
ORACLE["library_prep_exact"] = q(
    "SELECT kept.row_key, kept.molecule_id, sequence FROM kept JOIN pm ON kept.parent = pm.molecule_id", SAMPLE,
    f"tailed AS (SELECT * FROM mol WHERE {u('polya', 'row_key')} <= least(0.05::DOUBLE * {COUNTED}, 1.0))", CUTS.format("tailed"),
    "strands AS (SELECT sample_id, row_key || '.f' || k || '.cdna.cdna' AS row_key, molecule_id || '.f' || k || '.cdna.cdna' AS molecule_id, b - a AS n, substr(sequence, a::INT + 1, (b - a)::INT) AS sequence FROM frag WHERE b - a >= 20)",
    f"lig AS (SELECT row_key, molecule_id, pre_i5 || i5 || post_i5 || sequence || 'A' || pre_i7 || i7 || post_i7 AS sequence FROM strands JOIN samples USING (sample_id) WHERE {u('sizing', 'row_key')} < {PREP_P})",
    PCR.replace("FROM mol)", "FROM lig)"),
)
SX, SY, ST = CELL.sizes()
STEP, SHIFT = places(SEED, CELL)
ORACLE["coords_distinct"] = q(f"""SELECT row_key, ({CELL.tile[0]} + at_ // {SX * SY})::INT AS tile, ({CELL.x[0]} + at_ % {SX})::INT AS x, ({CELL.y[0]} + at_ // {SX} % {SY})::INT AS y FROM (
  SELECT row_key, (((row_number() OVER (ORDER BY sample_id, packet_id, ordinal, row_key) - 1)::HUGEINT * {STEP} + {SHIFT}) % {SX * SY * ST})::BIGINT AS at_ FROM mol)""")
ORACLE["cigar_chain_matched"] = ORACLE["cigar_chain"]
ORACLE["lineitem_quant"] = f"""SELECT sample_id, packet_id, transcript_id, count(*) AS counts FROM (
  SELECT (o % 2 + 1)::VARCHAR AS sample_id, (o % 4)::INT AS packet_id, 'T' || s AS transcript_id, k AS row_key, len FROM (
    SELECT l_orderkey * 8 + l_linenumber AS o, l_suppkey % 50 AS s, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS k, 40 + l_partkey % 217 + l_orderkey % 120 AS len FROM lineitem))
  WHERE {u('sizing', 'row_key')} < {SIZE_P} GROUP BY ALL"""
# base by base: places of a read's bases on the molecule, of the molecule's on the reference, and runs of both
SPLICED = """spliced AS (SELECT *, n // 4 AS p, n // 5 AS k, 6 + 3 * (n // 5) AS size, source_strand = '-' AS back, CASE WHEN ordinal % 2 = 0 THEN '+' ELSE '-' END AS own_strand FROM mol),
own AS (SELECT row_key, q0 + i AS q, b0 + i AS b FROM (SELECT row_key, unnest([5, 7 + k, 7 + 2 * k]) AS q0, unnest([3, 3 + k, 6 + 2 * k]) AS b0, k FROM spliced), (SELECT unnest(range(60)) AS i) WHERE i < k),
other AS (SELECT row_key, m0 + i AS m, r0 + i AS r FROM (SELECT row_key, unnest([1, 1 + p, 4 + 2 * p, 4 + 3 * p]) AS m0, unnest([0, p + 30, 2 * p + 30, 3 * p + 35]) + source_start AS r0, unnest([p, p, p, n - 3 * p - 3]) AS size FROM spliced), (SELECT unnest(range(260)) AS i) WHERE i < size),
aligned AS (SELECT row_key, CASE WHEN back THEN size + 1 - q ELSE q END AS q, r FROM spliced JOIN own USING (row_key) JOIN other USING (row_key) WHERE m = CASE WHEN back THEN len + 1 - b ELSE b END),
gaps AS (SELECT row_key, q, r, q - lag(q) OVER w AS dq, r - lag(r) OVER w AS dr, lag(r) OVER w AS r0 FROM aligned WINDOW w AS (PARTITION BY row_key ORDER BY q)),
runs AS (SELECT *, sum(CASE WHEN dq = 1 AND dr = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY row_key ORDER BY q) AS run FROM gaps),
parts AS (SELECT row_key, run, min(q) AS q, max(q) AS last, min(r) AS r, count(*) AS n, arg_min(dq, runs.q) AS dq, arg_min(dr, runs.q) AS dr, arg_min(r0, runs.q) AS r0 FROM runs GROUP BY ALL),
texts AS (SELECT row_key, min(parts.r) AS start, min(q) - 1 AS before, max(last) AS last, string_agg(CASE WHEN dq > 1 THEN (dq - 1) || 'I' ELSE '' END
  || CASE WHEN dr > 1 THEN (dr - 1) || CASE WHEN source_start + p > r0 AND source_start + p < parts.r THEN 'N' ELSE 'D' END ELSE '' END || parts.n || 'M', '' ORDER BY q) AS middle FROM parts JOIN spliced USING (row_key) GROUP BY row_key)"""
ORACLE["cigar_chain_spliced"] = q("""SELECT row_key, coalesce(start, source_start) AS start, CASE WHEN start IS NULL THEN size || 'S' ELSE CASE WHEN before > 0 THEN before || 'S' ELSE '' END || middle || CASE WHEN last < size THEN (size - last) || 'S' ELSE '' END END AS cigar,
  CASE WHEN own_strand = source_strand THEN '+' ELSE '-' END AS strand FROM spliced LEFT JOIN texts USING (row_key)""", SPLICED)
ORACLE["fastq_in_order"] = ORACLE["fastq_records"].replace("direction, status, '@'", "direction AS read, status, row_number() OVER (PARTITION BY sample_id, lane, direction, status ORDER BY tile, x, y, molecule_id) AS number, '@'")
ORACLE["bam_round_trip"] = ORACLE["sam_records"].replace("SELECT sample_id, lane, status, name", "SELECT name")
# a read is 40 bases on the strand of its molecule
ORACLE["bam_coverage"] = q("""SELECT source_chrom, source_strand, pos, sum(d) OVER (PARTITION BY source_chrom, source_strand ORDER BY pos)::BIGINT AS depth
  FROM (SELECT source_chrom, source_strand, p AS pos, sum(d) AS d FROM (SELECT source_chrom, source_strand, pos AS p, 1 AS d FROM reads UNION ALL SELECT source_chrom, source_strand, pos + 40, -1 FROM reads) GROUP BY ALL HAVING sum(d) <> 0)""", PLACED)
LONG = max(map(len, MIXED))
MIXED_SCORES = ", ".join(f"{LONG} - hamming(substr(w, 1, {len(o)}), '{o[::-1].translate(str.maketrans('ACGT', 'TGCA'))}')" for o in MIXED)
ORACLE["ribozero_sites_above"] = q(f"SELECT row_key, site, score FROM (SELECT row_key, site, greatest({MIXED_SCORES}) AS score FROM (SELECT row_key, site, substr(sequence, site::INT + 1, {LONG}) AS w FROM (SELECT row_key, sequence, unnest(range(len - {LONG - 1})) AS site FROM mol))) WHERE score >= {LEAST}")
CODES = """codes AS (SELECT c_custkey AS sample_id, translate(substr(md5(c_custkey::VARCHAR), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS code FROM customer),
clean AS (SELECT o_orderkey, translate(substr(md5(o_custkey::VARCHAR), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS c, (o_orderkey % 8)::INT AS at_, o_orderkey // 8 % 5 AS kind FROM orders),
wrong AS (SELECT *, CASE WHEN kind = 0 THEN c ELSE substr(c, 1, at_) || CASE WHEN kind = 4 THEN 'N' ELSE translate(substr(c, at_ + 1, 1), 'ACGT', 'CGTA') END || substr(c, at_ + 2) END AS w FROM clean),
twice AS (SELECT *, CASE WHEN kind = 3 THEN substr(w, 1, (at_ + 3) % 8) || 'A' || substr(w, (at_ + 3) % 8 + 2) ELSE w END AS v FROM wrong),
reads AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN substr(v, 1, 7) ELSE v END AS called_barcode FROM twice),
each AS (SELECT DISTINCT called_barcode FROM reads WHERE length(called_barcode) = 8),
near AS (SELECT called_barcode, sample_id, hamming(called_barcode, code) AS mismatches FROM each, codes WHERE hamming(called_barcode, code) <= 2)"""
ORACLE["barcode_matches"] = f"WITH {CODES} SELECT called_barcode, sample_id, mismatches FROM near"
ORACLE["demultiplex_all_samples"] = f"""WITH {CODES}, n AS (SELECT called_barcode, count(*) AS k, min(sample_id) AS one FROM near WHERE mismatches <= 1 GROUP BY 1)
SELECT o_orderkey, called_barcode, CASE WHEN k = 1 THEN one END AS found_sample, coalesce(k, 0) AS n_matches, CASE WHEN k = 1 THEN 'identified' WHEN k > 1 THEN 'ambiguous' ELSE 'unidentified' END AS status FROM reads LEFT JOIN n USING (called_barcode)"""
ORACLE["occurring_ids_bitmaps"] = ORACLE["occurring_ids"]
ORACLE["missing_ids_bitmaps"] = ORACLE["occurring_ids"].replace("SEMI JOIN", "ANTI JOIN")
ORACLE["step_summary_bitmaps"] = ORACLE["step_summary"]
INTERVALS = """lines AS (SELECT *, start + 20 + l_partkey % 180 AS end_ FROM (SELECT l_orderkey, l_linenumber, l_partkey, 'c' || l_suppkey % 5 AS chrom, (l_orderkey * 37 + l_linenumber * 101) % 1000000 + 1 AS start FROM lineitem)),
parts AS (SELECT *, start + 50 + p_size * 20 AS end_ FROM (SELECT p_partkey, p_size, 'c' || p_partkey % 5 AS chrom, p_partkey * 7919 % 1000000 + 1 AS start FROM part))"""
ORACLE["interval_overlaps"] = f"""WITH {INTERVALS} SELECT l_orderkey, l_linenumber, p_partkey, chrom, greatest(l.start, p.start) AS first, least(l.end_, p.end_) AS last
FROM lines l JOIN parts p USING (chrom) WHERE l.start <= p.end_ AND p.start <= l.end_"""
BLOCKS = """indels AS (SELECT chrom, pos, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del FROM (SELECT 'c' || o_custkey % 5 AS chrom, o_orderkey * 60 AS pos, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 + 1 ELSE 0 END AS ins, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey % 7 + 1 ELSE 0 END AS del FROM orders) GROUP BY ALL),
whole AS (SELECT DISTINCT chrom, (SELECT max(o_orderkey) * 60 + 100 FROM orders) AS length FROM indels),
edges AS (SELECT chrom, pos + del + 1 AS ref_start, sum(ins - del) OVER w AS shift, coalesce(lead(pos) OVER w, length) AS ref_end FROM indels JOIN whole USING (chrom) WINDOW w AS (PARTITION BY chrom ORDER BY pos)
  UNION ALL SELECT chrom, 1, 0, min(pos) FROM indels GROUP BY chrom),
blocks AS (SELECT chrom, (ref_start + shift)::BIGINT AS own_start, ref_start::BIGINT AS ref_start, (ref_end - ref_start + 1)::BIGINT AS n FROM edges WHERE ref_start <= ref_end)"""
ORACLE["genome_blocks"] = f"WITH {BLOCKS} SELECT chrom, own_start, ref_start, n FROM blocks"
ORACLE["transcript_alignments"] = f"""WITH {BLOCKS}, exons AS (SELECT *, start + 20 + p % 300 AS end_ FROM (SELECT l_orderkey AS t, 'c' || l_orderkey % 5 AS chrom, l_orderkey * 55 + l_linenumber * 400 AS start, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)),
placed AS (SELECT *, coalesce(sum(end_ - start + 1) OVER (PARTITION BY t ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_ FROM exons),
met AS (SELECT t, start AS exon, off_ + greatest(start, own_start) - start + 1 AS q, ref_start + greatest(start, own_start) - own_start AS r, least(end_, own_start + n - 1) - greatest(start, own_start) + 1 AS n FROM placed JOIN blocks USING (chrom) WHERE start <= own_start + n - 1 AND own_start <= end_),
gaps AS (SELECT *, q - lag(q + n) OVER w AS dq, r - lag(r + n) OVER w AS dr, exon <> lag(exon) OVER w AS other FROM met WINDOW w AS (PARTITION BY t ORDER BY q)),
texts AS (SELECT t, min(r)::BIGINT AS ref_start, min(q) - 1 AS before, max(q + n) AS past, string_agg(CASE WHEN dq > 0 THEN dq::BIGINT || 'I' ELSE '' END || CASE WHEN dr > 0 THEN dr::BIGINT || CASE WHEN other THEN 'N' ELSE 'D' END ELSE '' END || n::BIGINT || 'M', '' ORDER BY q) AS middle FROM gaps GROUP BY t),
sizes AS (SELECT t, chrom, sum(end_ - start + 1)::BIGINT AS size FROM exons GROUP BY ALL)
SELECT t AS transcript_id, chrom, CASE WHEN t % 2 = 0 THEN '+' ELSE '-' END AS strand, size, ref_start,
  CASE WHEN ref_start IS NULL THEN size || 'S' ELSE CASE WHEN before > 0 THEN before::BIGINT || 'S' ELSE '' END || middle || CASE WHEN past <= size THEN (size - past + 1)::BIGINT || 'S' ELSE '' END END AS ref_cigar
FROM sizes LEFT JOIN texts USING (t)"""
# the first read begins at the source's start, the second 40 bases before the molecule's end
ORACLE["sam_mates"] = q("""SELECT name AS qname, 3 + CASE WHEN direction = 1 THEN 64 ELSE 128 END + CASE WHEN strand = '-' THEN 16 ELSE 32 END AS flag, pos, '=' AS rnext, CASE WHEN direction = 1 THEN source_start + len - 40 ELSE source_start END AS pnext,
  CASE WHEN (direction = 1) = (len >= 40) THEN 1 ELSE -1 END * (CASE WHEN len >= 40 THEN len ELSE 80 - len END) AS tlen FROM reads""", PLACED)
