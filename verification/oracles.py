"""The same results in DuckDB SQL over the given tables."""

import re

TAB = "chr(9)"
AAS = "'ACDEFGHIKLMNPQRSTVWY'"
KEYS = """l_orderkey * 10 + l_linenumber AS POS,
  substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS REF, substr('CGTA', CAST(l_partkey % 4 AS INT) + 1, 1) AS ALT"""
VARIANT_KEYS = KEYS.replace("'CGTA'", "CASE WHEN l_partkey % 10 = 0 THEN 'GTAC' ELSE 'CGTA' END")
LABELS = "('Pathogenic', 'Likely_pathogenic', 'Benign', 'Likely_benign')"
CHUNK = 1000
HEADER = (
    "'##INFO=<ID=SCORE,Number=1,Type=Float,Description=\"ESM-2 based pathogenicity score. "
    "Log-Likelihood Ratio. Negative values indicate pathogenicity.\">'"
)
COLUMN_LINE = f"concat_ws({TAB}, '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO')"


def _info(key):
    return f"regexp_extract(INFO, '^(?:.*;)?{key}=([^;]*)', 1)"


# Views in dependency order.
VIEWS = {
    "fx_raw_scores": f"""
SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS VARCHAR)) AS CHROM, {KEYS},
  CAST(-((l_partkey * 37 + l_orderkey * 11) % 1500) - CASE WHEN l_returnflag = 'R' THEN 400 ELSE 0 END AS DOUBLE) / 100
    AS score, l_partkey AS ord
FROM lineitem""",
    "fx_scores": "SELECT CHROM, POS, REF, ALT, max(score) AS score FROM fx_raw_scores GROUP BY CHROM, POS, REF, ALT",
    "fx_clinvar": f"""
SELECT CAST(l_suppkey % 22 + 1 AS VARCHAR) AS CHROM, {VARIANT_KEYS},
  concat('ALLELEID=', CAST(l_partkey AS VARCHAR), ';DBFLAG;CLNREVSTAT=',
    CASE o_orderpriority WHEN '1-URGENT' THEN 'practice_guideline' WHEN '2-HIGH' THEN 'reviewed_by_expert_panel'
      WHEN '3-MEDIUM' THEN 'criteria_provided,_multiple_submitters,_no_conflicts'
      WHEN '4-NOT SPECIFIED' THEN 'criteria_provided,_single_submitter' ELSE 'no_assertion_criteria_provided' END,
    ';CLNSIG=', CASE WHEN l_returnflag = 'R' AND l_quantity < 25 THEN 'Pathogenic' WHEN l_returnflag = 'R' THEN 'Likely_pathogenic'
      WHEN l_returnflag = 'A' AND l_quantity < 25 THEN 'Benign' WHEN l_returnflag = 'A' THEN 'Likely_benign'
      ELSE 'Uncertain_significance' END,
    ';CLNVC=', CASE WHEN l_linenumber = 7 THEN 'Deletion' ELSE 'single_nucleotide_variant' END,
    ';GENEINFO=', replace(p_name, ' ', '_'), ':', CAST(p_partkey AS VARCHAR)) AS INFO
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_vcf_lines": f"""
SELECT concat_ws({TAB}, CHROM, CAST(POS AS VARCHAR), '.', REF, ALT, '.', '.', INFO) AS value FROM fx_clinvar
UNION ALL SELECT '##fileformat=VCFv4.2' UNION ALL SELECT {COLUMN_LINE}""",
    "fx_annotated": f"""
SELECT *, CASE WHEN CLNREVSTAT LIKE '%guideline%' OR CLNREVSTAT LIKE '%criteria\\_provided,\\_multiple\\_submitters%' ESCAPE '\\' THEN 4
    WHEN CLNREVSTAT LIKE '%reviewed\\_by\\_expert\\_panel%' ESCAPE '\\' THEN 3
    WHEN CLNREVSTAT LIKE '%criteria\\_provided,\\_conflicting\\_interpretations%' ESCAPE '\\' THEN 2
    WHEN CLNREVSTAT LIKE '%criteria\\_provided,\\_single\\_submitter%' ESCAPE '\\' THEN 2
    WHEN CLNREVSTAT LIKE '%no\\_criteria%' ESCAPE '\\' OR CLNREVSTAT LIKE '%single\\_submitter%' ESCAPE '\\' THEN 1 ELSE 0 END AS stars
FROM (SELECT *, {_info('CLNSIG')} AS CLNSIG, {_info('CLNVC')} AS CLNVC, {_info('CLNREVSTAT')} AS CLNREVSTAT,
  split_part({_info('GENEINFO')}, ':', 1) AS GENE FROM fx_clinvar) a""",
    "fx_kept": f"SELECT * FROM fx_annotated WHERE stars >= 1 AND CLNSIG IN {LABELS} AND CLNVC = 'single_nucleotide_variant'",
    "fx_vcf_multi": """
SELECT concat('chr', CHROM) AS CHROM, POS, REF, CASE WHEN POS % 10 = 1 THEN concat(ALT, ',', REF) ELSE ALT END AS ALT, INFO
FROM fx_clinvar""",
    "fx_labeled": f"""
SELECT c.CHROM, c.POS, c.REF, c.ALT, c.CLNSIG, CASE WHEN c.CLNSIG IN ('Pathogenic', 'Likely_pathogenic') THEN 1 ELSE 0 END AS y,
  s.score, CAST(0 AS DOUBLE) - s.score AS x
FROM fx_annotated c JOIN fx_scores s ON s.CHROM = concat('chr', c.CHROM) AND s.POS = c.POS AND s.REF = c.REF AND s.ALT = c.ALT
WHERE c.CLNSIG IN {LABELS}""",
    "fx_bench": f"""
SELECT c.CHROM, c.POS, c.REF, c.ALT, c.CLNSIG, s.score, CASE WHEN c.CLNSIG IN ('Pathogenic', 'Likely_pathogenic') THEN 1 ELSE 0 END AS y
FROM fx_kept c JOIN fx_scores s ON s.CHROM = concat('chr', c.CHROM) AND s.POS = c.POS AND s.REF = c.REF AND s.ALT = c.ALT""",
    "fx_contig": """
SELECT concat('c', CAST(doc_id AS VARCHAR)) AS contig, doc_id, seq FROM (
  SELECT doc_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq
  FROM documents) q WHERE length(seq) > 0""",
    "fx_regions": """
SELECT concat('tx', CAST(doc_id AS VARCHAR)) AS transcript_id, contig AS chrom, i * 280 + 11 AS start_pos, i * 280 + 55 + i % 3 AS end_pos,
  CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, '0' AS phase
FROM (SELECT doc_id, contig, unnest(range(0, (length(seq) - 57) // 280 + 1)) AS i FROM fx_contig WHERE length(seq) >= 57) e
UNION ALL SELECT * FROM (SELECT concat('in', CAST(doc_id AS VARCHAR)), contig,
    CASE WHEN i = 0 THEN 1 ELSE (i - 1) * 280 + 56 + (i - 1) % 3 END AS a, CASE WHEN i = n THEN size ELSE i * 280 + 10 END AS b,
    CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END, '0'
  FROM (SELECT *, unnest(range(0, n + 1)) AS i
    FROM (SELECT doc_id, contig, length(seq) AS size, CASE WHEN length(seq) >= 57 THEN (length(seq) - 57) // 280 + 1 ELSE 0 END AS n FROM fx_contig) f) g) h
WHERE a <= b""",
    "fx_transcripts": """
SELECT kind || CAST(doc_id AS VARCHAR) AS transcript_id, (doc_id % 2 = 0) = (kind = 'tx') AS forward,
  length(regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g'))
    < CASE kind WHEN 'tx' THEN 57 ELSE 1 END AS bare
FROM documents, (VALUES ('tx'), ('in')) v(kind)""",
    "fx_exons": """
SELECT *, CAST(coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY transcript_id
  ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cds_start
FROM fx_regions""",
    "fx_bases": """
SELECT transcript_id, chrom, strand, cds_start + k AS cds_offset,
  CASE WHEN strand = '-' THEN end_pos - k ELSE start_pos + k END AS pos
FROM (SELECT *, unnest(range(0, end_pos - start_pos + 1)) AS k FROM fx_exons) b""",
    "fx_cds": """
SELECT r.transcript_id, any_value(r.strand) AS strand,
  CASE WHEN any_value(r.strand) = '-' THEN reverse(translate(string_agg(substr(c.seq, r.start_pos, r.end_pos - r.start_pos + 1), '' ORDER BY r.start_pos), 'ACGT', 'TGCA'))
    ELSE string_agg(substr(c.seq, r.start_pos, r.end_pos - r.start_pos + 1), '' ORDER BY r.start_pos) END AS cds
FROM fx_regions r JOIN fx_contig c ON r.chrom = c.contig GROUP BY r.transcript_id""",
    "fx_code": """
SELECT b1.b || b2.b || b3.b AS codon, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', b1.i * 16 + b2.i * 4 + b3.i + 1, 1) AS aa
FROM (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) b1(i, b), (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) b2(i, b),
  (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) b3(i, b)""",
    "fx_snv": """
SELECT c.codon, p.place, substr(c.codon, p.place + 1, 1) AS ref, b.b AS alt, c.aa AS ref_aa, d.aa AS alt_aa
FROM fx_code c, (VALUES (0), (1), (2)) p(place), (VALUES ('A'), ('C'), ('G'), ('T')) b(b), fx_code d
WHERE b.b <> substr(c.codon, p.place + 1, 1) AND d.codon = substr(c.codon, 1, p.place) || b.b || substr(c.codon, p.place + 2)""",
    "fx_missense": "SELECT * FROM fx_snv WHERE ref_aa <> '*' AND alt_aa <> '*' AND ref_aa <> alt_aa",
    "fx_codons": """
SELECT transcript_id, strand, i AS codon_idx, substr(cds, i * 3 + 1, 3) AS codon
FROM (SELECT *, unnest(range(0, length(cds) // 3)) AS i FROM fx_cds) u""",
    "fx_logits": """
SELECT vec_id, [list_sum([CAST(embedding[k] AS DOUBLE) FOR k IN range(j, len(embedding) + 1, 20)]) FOR j IN range(1, 21)] AS lg FROM embeddings""",
    "fx_positions": f"""
SELECT k.transcript_id, k.codon_idx, k.codon, k.strand, code.aa AS ref_aa, e.lg
FROM fx_codons k JOIN fx_code code ON k.codon = code.codon
JOIN fx_logits e ON e.vec_id = (CAST(substr(k.transcript_id, 3) AS BIGINT) * 30 + k.codon_idx) % (SELECT count(*) FROM embeddings)""",
    "fx_cds_snvs": """
SELECT k.transcript_id, k.codon_idx, k.codon_idx * 3 + m.place AS cds_pos, k.codon, m.ref_aa, m.alt_aa, m.ref, m.alt, k.strand
FROM fx_codons k JOIN fx_missense m ON k.codon = m.codon""",
    "fx_placed_snvs": """
SELECT k.transcript_id, k.codon_idx, k.cds_pos, k.codon, k.ref_aa, k.alt_aa, b.chrom AS CHROM, b.pos AS POS,
  CASE WHEN k.strand = '-' THEN translate(k.ref, 'ACGT', 'TGCA') ELSE k.ref END AS REF,
  CASE WHEN k.strand = '-' THEN translate(k.alt, 'ACGT', 'TGCA') ELSE k.alt END AS ALT, k.strand
FROM fx_cds_snvs k JOIN fx_bases b ON b.transcript_id = k.transcript_id AND b.cds_offset = k.cds_pos""",
    "fx_raw_generated": f"""
SELECT s.CHROM, s.POS, s.REF, s.ALT, p.lg[instr({AAS}, s.alt_aa)] - p.lg[instr({AAS}, s.ref_aa)] AS raw, s.transcript_id AS TranscriptID,
  s.transcript_id AS ProteinID, CAST(s.codon_idx + 1 AS VARCHAR) AS ProteinPos, s.ref_aa AS RefAA, s.alt_aa AS AltAA, s.strand
FROM fx_placed_snvs s JOIN fx_positions p ON p.transcript_id = s.transcript_id AND p.codon_idx = s.codon_idx""",
    "fx_generated": """
SELECT CHROM, POS, REF, ALT, round(raw, 6) AS score, TranscriptID, ProteinID, ProteinPos, RefAA, AltAA, strand FROM fx_raw_generated""",
    "fx_mutations": f"""
SELECT concat('T', CAST(l_suppkey AS VARCHAR)) AS transcript_id, concat('P', CAST(l_partkey % 50 AS VARCHAR)) AS protein_id, l_linenumber AS protein_pos,
  substr({AAS}, CAST(l_partkey % 20 AS INT) + 1, 1) AS ref_aa, substr({AAS}, CAST((l_partkey + 1 + l_orderkey % 19) % 20 AS INT) + 1, 1) AS alt_aa,
  CAST(-(l_orderkey * 7 % 1500) AS DOUBLE) / 100 AS score, l_orderkey AS ord FROM lineitem""",
    "fx_last_mutations": """
SELECT protein_id, protein_pos, alt_aa, arg_max(score, {'o': ord, 's': score}) AS score
FROM fx_mutations GROUP BY protein_id, protein_pos, alt_aa""",
    "fx_alts": """
SELECT CHROM, POS, REF, ALT AS alts, INFO, unnest(string_split(ALT, ',')) AS ALT, generate_subscripts(string_split(ALT, ','), 1) - 1 AS alt_idx
FROM fx_vcf_multi""",
}

# Label table -> exact split. {src} is the labelled view, {frac} the test share.
SPLIT = """
s_n AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM {src} GROUP BY y),
s_t AS (SELECT *, total - CAST(ceil(CAST({frac} AS DOUBLE) * total) AS HUGEINT) AS n_train FROM s_n),
s_f AS (SELECT *, n * n_train // total AS share, n * n_train % total AS rest FROM s_t),
s_k AS (SELECT y, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= n_train - sum(share) OVER () THEN 1 ELSE 0 END AS k FROM s_f),
s_r AS (SELECT l.*, row_number() OVER (PARTITION BY l.y ORDER BY md5(concat('42;', {hashed}))) AS rn FROM {src} l),
s_split AS (SELECT r.*, CASE WHEN r.rn <= k.k THEN 'train' ELSE 'test' END AS split FROM s_r r JOIN s_k k ON r.y = k.y)"""


def _measured(columns):
    """Each text behind its length, so that no two rows give one text."""
    texts = [f"CAST({c} AS VARCHAR)" for c in columns.split()]
    return ", ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts)


LABELED_SPLIT = SPLIT.replace("{src}", "fx_labeled").replace("{hashed}", _measured("CHROM POS REF ALT CLNSIG y score"))
BENCH_SPLIT = SPLIT.replace("{src}", "fx_bench").replace("{hashed}", _measured("CHROM POS REF ALT CLNSIG score y"))

# Distinct scores of {src} with running totals from the highest down.
POINTS = """
c_g AS (SELECT x, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM {src} GROUP BY x),
c_p AS (SELECT x, pos, neg, CAST(sum(pos) OVER (ORDER BY x DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY x DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N,
  lead(pos) OVER (ORDER BY x DESC) AS npos, lead(neg) OVER (ORDER BY x DESC) AS nneg, row_number() OVER (ORDER BY x DESC) AS rn FROM c_g),
c_roc AS (SELECT x AS threshold, CAST(tp AS DOUBLE) / P AS tpr, CAST(fp AS DOUBLE) / N AS fpr FROM c_p
    WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)),
c_auc AS (SELECT CAST(sum(CAST(pos AS HUGEINT) * (2 * (N - fp) + neg)) AS DOUBLE) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE) * 2) AS auc FROM c_p)"""
LABELED_POINTS = POINTS.replace("{src}", "fx_labeled")


def _sql(body, *ctes):
    """WITH the needed views (found by name, in order), then the extra CTEs, then the body."""
    needed, text = [], body + "".join(ctes)
    for name in reversed(list(VIEWS)):
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, name)
            text += VIEWS[name]
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed] + [c.strip() for c in ctes]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _deep(body):
    """`body` over the hierarchy of features: edges, the CDS with their parents, and all paths upwards."""
    doc = "CAST(doc_id AS VARCHAR)"
    kind = "CAST(substr(transcript_id, 3) AS BIGINT) % 3"
    exon = "concat('ex_', transcript_id, '_', CAST(start_pos AS VARCHAR))"
    edges = f"""edges AS (SELECT concat(kind, {doc}) AS id, concat('g', {doc}) AS parent FROM documents, (VALUES ('tx'), ('in')) v(kind)
UNION ALL SELECT concat('pep_', kind, {doc}), concat(kind, {doc}) FROM documents, (VALUES ('tx'), ('in')) v(kind) WHERE doc_id % 3 = 1
UNION ALL SELECT {exon}, transcript_id FROM fx_regions WHERE {kind} = 0)"""
    cds = f"""cds AS (SELECT *, CASE {kind} WHEN 0 THEN {exon} WHEN 1 THEN concat('pep_', transcript_id) ELSE transcript_id END AS parent
FROM fx_regions)"""
    paths = """paths AS (SELECT id, parent AS ancestor, 1 AS hops FROM edges
UNION ALL SELECT p.id, e.parent, hops + 1 FROM paths p JOIN edges e ON e.id = p.ancestor)"""
    return _sql(body, edges, cds, paths).replace("WITH ", "WITH RECURSIVE ", 1)


def _json(fields):
    """SQL text of a JSON object: names of columns by kind (`f` six decimals, `i` integer or boolean, `s` text) or sections."""
    items = []
    for name, kind in fields.items():
        if isinstance(kind, dict):
            value = _json(kind)
        elif kind == "s":
            value = f"""'"' || "{name}" || '"'"""
        else:
            value = f"""CAST({f'CAST("{name}" AS DECIMAL(38,6))' if kind == "f" else f'"{name}"'} AS VARCHAR)"""
        items.append(f"""'"{name}":' || {value}""")
    return "'{' || " + " || ',' || ".join(items) + " || '}'"


def _kinds(text):
    """`name` is a fraction, `name:i` and `name:s` are others."""
    return {item.split(":")[0]: (item.split(":") + ["f"])[1] for item in text.split()}


THREE_SECTIONS = {
    "thresholds": _kinds("p_threshold b_threshold"),
    "predictions": _kinds("predicted_P:i predicted_B:i VUS:i"),
    "true_labels_in_prediction": _kinds("true_P_predicted_P:i true_P_in_VUS:i true_B_predicted_B:i true_B_in_VUS:i"),
    "performance": _kinds("AUC PPV_P NPV_B sensitivity_P specificity_B coverage_P coverage_B"),
    "totals": _kinds("total_P:i total_B:i"),
}


def _ratio(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def _three(src, p, b):
    """The flat three-class report over {src}(x, y)."""
    cell = "count(*) FILTER (WHERE pred = {} AND y = {})".format
    return f"""
SELECT {p} AS p_threshold, {b} AS b_threshold, pp AS "predicted_P", pb AS "predicted_B", vus AS "VUS", tpp AS "true_P_predicted_P", tpv AS "true_P_in_VUS",
  tbb AS "true_B_predicted_B", tbv AS "true_B_in_VUS", (SELECT auc FROM c_auc) AS "AUC", {_ratio('tpp', 'pp')} AS "PPV_P", {_ratio('tbb', 'pb')} AS "NPV_B",
  {_ratio('tpp', 'np')} AS "sensitivity_P", {_ratio('tbb', 'nb')} AS "specificity_B", {_ratio('pp', 'np')} AS "coverage_P", {_ratio('pb', 'nb')} AS "coverage_B",
  np AS "total_P", nb AS "total_B"
FROM (SELECT count(*) FILTER (WHERE pred = 1) AS pp, count(*) FILTER (WHERE pred = 0) AS pb, count(*) FILTER (WHERE pred = -1) AS vus,
    {cell(1, 1)} AS tpp, {cell(-1, 1)} AS tpv, {cell(0, 0)} AS tbb, {cell(-1, 0)} AS tbv,
    count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nb
  FROM (SELECT *, CASE WHEN x < 0 - {b} THEN 0 WHEN x > 0 - {p} THEN 1 ELSE -1 END AS pred FROM {src}) q) t"""


def _binary_cells(src, condition):
    return f"""SELECT count(*) FILTER (WHERE y = 0 AND NOT pred) AS tn, count(*) FILTER (WHERE y = 0 AND pred) AS fp,
  count(*) FILTER (WHERE y = 1 AND NOT pred) AS fn, count(*) FILTER (WHERE y = 1 AND pred) AS tp FROM (SELECT *, {condition} AS pred FROM {src}) q"""


BINARY_METRICS = f"""(SELECT auc FROM c_auc) AS auc, {_ratio('tp', '(tp + fn)')} AS sensitivity, {_ratio('tn', '(tn + fp)')} AS specificity,
  {_ratio('tp', '(tp + fp)')} AS precision, {_ratio('tn', '(tn + fn)')} AS npv, tp, tn, fp, fn"""

# Sliding precision thresholds on c_p; {ppv} and {npv} are the targets.
SLIDE = """
p_a AS (SELECT x, CAST(tp AS DOUBLE) / (tp + fp) AS ppv, CAST(N - fp + neg AS DOUBLE) / ((N - fp + neg) + (P - tp + pos)) AS npv FROM c_p),
p_b AS (SELECT coalesce(min(x) FILTER (WHERE ppv >= {ppv}), arg_max(x, {{'v': ppv, 'x': x}})) AS px,
  coalesce(max(x) FILTER (WHERE npv >= {npv}), arg_max(x, {{'v': npv, 'x': -x}})) AS bx FROM p_a),
p_c AS (SELECT px, bx, (SELECT ppv FROM p_a WHERE x = px) AS ppv, (SELECT npv FROM p_a WHERE x = bx) AS npv, px <= bx AS adjusted,
  (SELECT quantile_cont(x, 0.8) FROM {src}) AS q80, (SELECT quantile_cont(x, 0.2) FROM {src}) AS q20 FROM p_b),
p_t AS (SELECT ppv, npv, adjusted, -CASE WHEN adjusted THEN q80 ELSE px END AS p_threshold, -CASE WHEN adjusted THEN q20 ELSE bx END AS b_threshold FROM p_c)"""

FILTER_COLUMNS = "CHROM, POS, REF, ALT, CLNSIG, stars, CLNVC"
GENERATED = "CHROM, POS, REF, ALT, score, TranscriptID, ProteinID, ProteinPos, RefAA, AltAA"
BODY_LINE = f"concat_ws({TAB}, CHROM, CAST(POS AS VARCHAR), '.', REF, ALT, '.', '.', {{}})"
ANNOTATED = f"""
SELECT r.CHROM, r.POS, r.REF, r.ALT, r.INFO, b.score FROM fx_vcf_multi r
LEFT JOIN (SELECT a.CHROM, a.POS, a.REF, a.alts, arg_max(s.score, {{'i': a.alt_idx, 's': s.score}}) AS score
    FROM (SELECT DISTINCT CHROM, POS, REF, alts, ALT, alt_idx FROM fx_alts) a
    JOIN fx_scores s ON s.CHROM = a.CHROM AND s.POS = a.POS AND s.REF = a.REF AND s.ALT = a.ALT GROUP BY ALL) b
  ON b.CHROM = r.CHROM AND b.POS = r.POS AND b.REF = r.REF AND b.alts = r.ALT"""
SCORED_CLINVAR = """fx_clinvar c {} JOIN fx_scores s ON s.CHROM = concat('chr', c.CHROM) AND s.POS = c.POS AND s.REF = c.REF AND s.ALT = c.ALT"""
MATRIX_COLUMNS = ", ".join(
    f'round(lg[{i}] - lg[instr({AAS}, ref_aa)], 6) AS "{aa}"' for i, aa in enumerate("ACDEFGHIKLMNPQRSTVWY", 1)
)
LOG_PROB_COLUMNS = ", ".join(
    f'round({i} * (codon_idx + 1) % 13 / 4.0::DOUBLE - z, 6) AS "log_prob_{aa}"' for i, aa in enumerate("ACDEFGHIKLMNPQRSTVWY", 1)
)
PIVOT_COLUMNS = ", ".join(f"max(score) FILTER (WHERE alt_aa = '{aa}') AS \"{aa}\"" for aa in "ACDEFGHIKLMNPQRSTVWY")


def _nearest(target, where="TRUE"):
    return f"""(SELECT {{'t': threshold, 'tpr': tpr, 'fpr': fpr}} FROM c_roc WHERE {where}
    ORDER BY abs(CAST(1 AS DOUBLE) - fpr - CAST({target} AS DOUBLE)), threshold DESC LIMIT 1)"""


ORACLES = {
    # ---- sources
    "scan_scores": _sql("SELECT * FROM fx_scores"),
    "scan_scores_tsv": _sql("SELECT * FROM fx_scores"),
    "scores_count": _sql("SELECT count(*) AS n_rows FROM fx_scores"),
    "scan_vcf_lines": _sql(
        "SELECT CHROM, POS, '.' AS ID, REF, ALT, '.' AS QUAL, '.' AS FILTER, INFO FROM fx_clinvar"
    ),
    "vcf_header": _sql("SELECT value FROM fx_vcf_lines WHERE value LIKE '#%'"),
    "clinvar_records": _sql("SELECT CHROM, POS, REF, ALT, CLNSIG, CLNREVSTAT, stars, GENE FROM fx_annotated"),
    "read_split": _sql(
        "SELECT CHROM, POS, REF, ALT, CLNSIG, score FROM s_split WHERE split = 'train'", LABELED_SPLIT.format(frac=0.7)
    ),
    "mutations_scan": _sql(
        "SELECT transcript_id, protein_id, protein_pos, ref_aa, alt_aa, score FROM fx_mutations"
    ),
    "gff_cds": _sql("SELECT * FROM fx_regions"),
    "fasta_chunks": _sql(
        f"""SELECT contig, bin, substr(seq, bin * {CHUNK} + 1, {CHUNK}) AS chunk
FROM (SELECT contig, seq, unnest(range(0, (length(seq) - 1) // {CHUNK} + 1)) AS bin FROM fx_contig) b"""
    ),
    # ---- sinks
    "to_vcf_lines": _sql(f"SELECT {BODY_LINE.format('''printf('SCORE=%.4f', score)''')} AS value FROM fx_scores"),
    "vcf_header_out": _sql(
        f"""SELECT {BODY_LINE.format('''printf('SCORE=%.4f', score)''')} AS value FROM fx_scores
UNION ALL SELECT '##fileformat=VCFv4.2' UNION ALL SELECT {HEADER} UNION ALL SELECT {COLUMN_LINE}"""
    ),
    "filter_clinvar_lines": _sql(
        f"""SELECT value FROM fx_vcf_lines WHERE value LIKE '#%'
UNION ALL SELECT {BODY_LINE.format('INFO')} AS value FROM fx_kept"""
    ),
    "annotate_lines": _sql(
        f"""SELECT concat_ws({TAB}, c.CHROM, CAST(c.POS AS VARCHAR), '.', c.REF, c.ALT, '.', '.',
  CASE WHEN s.score IS NULL THEN c.INFO ELSE c.INFO || ';' || printf('SCORE=%.4f', s.score) END) AS value
FROM {SCORED_CLINVAR.format('LEFT')} UNION ALL SELECT '##fileformat=VCFv4.2' UNION ALL SELECT {HEADER} UNION ALL SELECT {COLUMN_LINE}"""
    ),
    "report_json": _sql(
        f"""SELECT {_json({k: v for section in THREE_SECTIONS.values() for k, v in section.items()})} AS value
FROM ({_three('fx_labeled', '-11.6::DOUBLE', '-8.5::DOUBLE')}) r""",
        LABELED_POINTS,
    ),
    "resume_remaining": _sql("SELECT transcript_id FROM fx_transcripts WHERE forward OR bare"),
    "test_predictions": _sql(
        "SELECT CHROM, POS, REF, ALT, CLNSIG, score, y FROM s_split WHERE split = 'test'",
        LABELED_SPLIT.format(frac=0.8),
    ),
    "records_round_trip": _sql(f"SELECT {GENERATED} FROM fx_generated"),
    # ---- projections, filters, labels
    "resolve_score": _sql("SELECT CHROM, POS, REF, ALT, score - 2 AS score FROM fx_scores"),
    "norm_chrom": _sql("SELECT CHROM, POS FROM fx_clinvar"),
    "query_variant": _sql("SELECT * FROM fx_scores ORDER BY POS, CHROM, REF, ALT LIMIT 1"),
    "filter_stars": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_annotated WHERE stars >= 3"),
    "filter_include": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_annotated WHERE CLNSIG IN ('Pathogenic', 'Benign')"),
    "filter_exclude": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_annotated WHERE CLNSIG <> 'Likely_benign'"),
    "filter_default_exclude": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_annotated WHERE CLNSIG IN {LABELS}"),
    "filter_snv": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_annotated WHERE CLNVC = 'single_nucleotide_variant'"),
    "filter_clinvar": _sql(f"SELECT {FILTER_COLUMNS} FROM fx_kept"),
    "filter_by_score": _sql("SELECT * FROM fx_scores WHERE score BETWEEN -12 AND -3"),
    "query_mutation": _sql(
        "SELECT * FROM fx_last_mutations WHERE protein_id = 'P7' AND protein_pos = 3 AND alt_aa = 'L'"
    ),
    "label_strict": _sql(
        f"""SELECT CHROM, POS, REF, ALT, CLNSIG, CASE WHEN CLNSIG IN ('Pathogenic', 'Likely_pathogenic') THEN 1 ELSE 0 END AS y
FROM fx_annotated WHERE CLNSIG IN {LABELS}"""
    ),
    "label_lenient": _sql(
        """SELECT CHROM, POS, REF, ALT, CLNSIG, CASE WHEN CLNSIG IN ('Pathogenic', 'Likely_pathogenic') THEN 1 ELSE 0 END AS y
FROM fx_annotated"""
    ),
    "negate_score": _sql("SELECT *, CAST(0 AS DOUBLE) - score AS x FROM fx_scores"),
    "predict_binary": _sql(
        "SELECT CHROM, POS, REF, ALT, score, y, CASE WHEN score < -10 THEN 1 ELSE 0 END AS prediction FROM fx_labeled"
    ),
    "predict_three": _sql(
        """SELECT CHROM, POS, REF, ALT, score, y, CASE WHEN score > -8.5 THEN 0 WHEN score < -11.6 THEN 1 ELSE -1 END AS prediction
FROM fx_labeled"""
    ),
    # ---- scalar functions
    "parse_info": _sql(
        f"""SELECT CHROM, POS, {_info('CLNSIG')} AS CLNSIG, {_info('CLNVC')} AS CLNVC, {_info('CLNREVSTAT')} AS CLNREVSTAT,
  {_info('GENEINFO')} AS GENEINFO, CAST(NULL AS VARCHAR) AS DBFLAG FROM fx_clinvar"""
    ),
    "review_stars": _sql("SELECT CLNREVSTAT, stars, count(*) AS n FROM fx_annotated GROUP BY CLNREVSTAT, stars"),
    "gene_symbol": _sql("SELECT GENE, count(*) AS n FROM fx_annotated GROUP BY GENE"),
    "split_alts": _sql("SELECT CHROM, POS, REF, alt_idx, ALT FROM fx_alts"),
    "info_text": _sql("SELECT CHROM, POS, replace(INFO, 'DBFLAG;', '') AS INFO FROM fx_clinvar"),
    "vcf_full_info": _sql(
        f"""SELECT {BODY_LINE.format(
            "concat(printf('SCORE=%.4f', score), ';ProteinID=', ProteinID, ';ProteinPos=', ProteinPos, ';RefAA=', RefAA, ';AltAA=', AltAA)"
        )} AS value FROM fx_generated"""
    ),
    "reverse_complement": _sql("SELECT contig, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM fx_contig"),
    "translate_cds": _sql(
        """SELECT k.transcript_id, string_agg(c.aa, '' ORDER BY k.codon_idx) AS protein
FROM fx_codons k JOIN fx_code c ON k.codon = c.codon GROUP BY k.transcript_id"""
    ),
    "codon_aa": _sql(
        "SELECT k.codon, c.aa, count(*) AS n FROM fx_codons k JOIN fx_code c ON k.codon = c.codon GROUP BY k.codon, c.aa"
    ),
    "aa_to_codons": _sql(
        """SELECT c.aa, string_agg(c.codon, ',' ORDER BY c.codon) AS codons
FROM fx_code c WHERE c.codon IN (SELECT codon FROM fx_codons) GROUP BY c.aa"""
    ),
    "cds_length": _sql(
        "SELECT transcript_id, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS cds_length FROM fx_regions GROUP BY transcript_id"
    ),
    "cds_to_genome": _sql("SELECT transcript_id, cds_offset, chrom, pos FROM fx_bases"),
    "log_softmax": _sql(
        "SELECT v.vec_id, CAST(aa_idx AS INT) AS aa_idx, round(lg - top - z, 6) AS log_prob FROM v JOIN t ON v.vec_id = t.vec_id",
        "v AS (SELECT vec_id, i AS aa_idx, lg[i + 1] AS lg FROM (SELECT *, unnest(range(0, 20)) AS i FROM fx_logits) e)",
        "m AS (SELECT vec_id, max(lg) AS top FROM v GROUP BY vec_id)",
        "t AS (SELECT v.vec_id, any_value(m.top) AS top, ln(sum(exp(v.lg - m.top))) AS z FROM v JOIN m ON v.vec_id = m.vec_id GROUP BY v.vec_id)",
    ),
    "variant_llr": _sql(
        f"""SELECT m.transcript_id, m.protein_pos, m.ref_aa, m.alt_aa, m.ord,
  CASE WHEN k.aa = m.ref_aa THEN round(e.lg[instr({AAS}, m.alt_aa)] - e.lg[instr({AAS}, m.ref_aa)], 6) END AS llr
FROM (SELECT concat(CASE protein_pos % 2 WHEN 0 THEN 'tx' ELSE 'in' END, CAST(ord % (SELECT count(*) FROM documents) AS VARCHAR)) AS transcript_id, protein_pos, ref_aa, alt_aa, ord,
    ord % (SELECT count(*) FROM embeddings) AS vec_id FROM fx_mutations) m
JOIN fx_cds t ON t.transcript_id = m.transcript_id JOIN fx_logits e ON e.vec_id = m.vec_id
LEFT JOIN (SELECT transcript_id, codon_idx, aa FROM fx_codons JOIN fx_code USING (codon)) k
  ON k.transcript_id = m.transcript_id AND k.codon_idx = m.protein_pos"""
    ),
    "aa_index": _sql(
        f"""SELECT alt_aa, CAST(instr({AAS}, alt_aa) - 1 AS INT) AS aa_idx, substr({AAS}, CAST(instr({AAS}, alt_aa) AS INT), 1) AS aa_back, count(*) AS n
FROM fx_mutations GROUP BY ALL"""
    ),
    # ---- joins
    "lookup_scores": _sql(f"SELECT DISTINCT c.CHROM, c.POS, c.REF, c.ALT, s.score FROM {SCORED_CLINVAR.format('')}"),
    "annotate": _sql(f"SELECT c.*, s.score FROM {SCORED_CLINVAR.format('LEFT')}"),
    "annotate_multiallelic": _sql(
        f"""SELECT CHROM, POS, REF, ALT, CASE WHEN score IS NULL THEN INFO ELSE INFO || ';' || printf('SCORE=%.4f', score) END AS INFO, score
FROM ({ANNOTATED}) a"""
    ),
    "score_variants": _sql(f"SELECT c.*, s.score FROM {SCORED_CLINVAR.format('')}"),
    "transcript_cds": _sql("SELECT * FROM fx_regions"),
    "fetch_regions": _sql(
        f"""SELECT transcript_id, chrom, start_pos, greatest(start_pos, bin * {CHUNK} + 1) AS piece_start, least(end_pos, (bin + 1) * {CHUNK}) AS piece_end,
  substr(seq, greatest(start_pos, bin * {CHUNK} + 1), least(end_pos, (bin + 1) * {CHUNK}) - greatest(start_pos, bin * {CHUNK} + 1) + 1) AS seq
FROM (SELECT r.*, c.seq, unnest(range((start_pos - 1) // {CHUNK}, (end_pos - 1) // {CHUNK} + 1)) AS bin FROM fx_regions r JOIN fx_contig c ON c.contig = r.chrom) b"""
    ),
    "codon_mutations": _sql(
        """SELECT m.codon, m.place, m.ref, m.alt, m.ref_aa, m.alt_aa, count(*) AS n FROM fx_codons k JOIN fx_snv m ON k.codon = m.codon
WHERE m.ref_aa <> m.alt_aa GROUP BY ALL"""
    ),
    "missense_scores": _sql(
        f"""SELECT p.transcript_id, p.codon_idx, p.codon_idx * 3 + m.place AS cds_pos, m.ref, m.alt, m.ref_aa, m.alt_aa,
  round(p.lg[instr({AAS}, m.alt_aa)] - p.lg[instr({AAS}, m.ref_aa)], 6) AS llr
FROM fx_positions p JOIN fx_missense m ON p.codon = m.codon"""
    ),
    # ---- aggregates, curves, splits
    "count_clinsig": _sql(
        f"""SELECT l.CLNSIG, count(a.CLNSIG) AS n FROM (SELECT unnest(['Pathogenic', 'Likely_pathogenic', 'Benign', 'Likely_benign']) AS CLNSIG) l
LEFT JOIN fx_annotated a ON a.CLNSIG = l.CLNSIG GROUP BY l.CLNSIG"""
    ),
    "filter_summary": _sql("SELECT (SELECT count(*) FROM fx_clinvar) AS total, (SELECT count(*) FROM fx_kept) AS kept"),
    "split_stats": _sql(
        """SELECT split, count(*) AS n, count(*) FILTER (WHERE CLNSIG = 'Pathogenic') AS "Pathogenic", count(*) FILTER (WHERE CLNSIG = 'Likely_pathogenic') AS "Likely_pathogenic",
  count(*) FILTER (WHERE CLNSIG = 'Benign') AS "Benign", count(*) FILTER (WHERE CLNSIG = 'Likely_benign') AS "Likely_benign",
  count(*) FILTER (WHERE y = 1) AS "Total_P", count(*) FILTER (WHERE y = 0) AS "Total_B" FROM s_split GROUP BY split""",
        LABELED_SPLIT.format(frac=0.7),
    ),
    "distinct_keys": _sql("SELECT DISTINCT CHROM, POS, REF, ALT FROM fx_clinvar"),
    "roc_curve": _sql("SELECT * FROM c_roc", LABELED_POINTS),
    "roc_curve_full": _sql(
        """SELECT x AS threshold, CAST(tp AS DOUBLE) / P AS tpr, CAST(fp AS DOUBLE) / N AS fpr FROM c_p
UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
        LABELED_POINTS,
    ),
    "roc_auc": _sql("SELECT auc FROM c_auc", LABELED_POINTS),
    "pr_curve": _sql(
        """SELECT x AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / P AS recall FROM c_p
UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""",
        LABELED_POINTS,
    ),
    "confusion_binary": _sql(_binary_cells("fx_labeled", "score < -10")),
    "evaluate_binary": _sql(
        f"SELECT {BINARY_METRICS} FROM ({_binary_cells('fx_labeled', 'score < -10')}) b", LABELED_POINTS
    ),
    "evaluate_three_class": _sql(_three("fx_labeled", "-11.6::DOUBLE", "-8.5::DOUBLE"), LABELED_POINTS),
    "dedupe_scores": _sql(
        "SELECT CHROM, POS, REF, ALT, arg_max(score, {'o': ord, 's': score}) AS score FROM fx_raw_scores GROUP BY CHROM, POS, REF, ALT"
    ),
    "score_median": _sql("SELECT quantile_cont(x, 0.5) AS median FROM fx_labeled"),
    "score_percentiles": _sql(
        """SELECT round(quantile_cont(x, 0.15), 9) AS q0, round(quantile_cont(x, 0.2), 9) AS q1, round(quantile_cont(x, 0.8), 9) AS q2,
  round(quantile_cont(x, 0.85), 9) AS q3 FROM fx_labeled"""
    ),
    "all_transcripts": _sql("SELECT transcript_id FROM fx_transcripts"),
    "extract_cds": _sql("SELECT transcript_id, strand, cds FROM fx_cds"),
    "mutation_matrix": _sql(
        f"SELECT transcript_id, codon_idx, ref_aa, {MATRIX_COLUMNS} FROM fx_positions WHERE ref_aa <> '*'"
    ),
    "mutation_matrix_pivot": _sql(
        f"SELECT protein_id, protein_pos, {PIVOT_COLUMNS} FROM fx_last_mutations GROUP BY protein_id, protein_pos"
    ),
    "conservation": _sql(
        f"""SELECT transcript_id, codon_idx, round(list_sum([abs(v - lg[instr({AAS}, ref_aa)]) FOR v IN lg]) / 19, 6) AS conservation
FROM fx_positions WHERE ref_aa <> '*'"""
    ),
    "stratified_split": _sql(
        "SELECT CHROM, POS, REF, ALT, CLNSIG, y, score, split FROM s_split", LABELED_SPLIT.format(frac=0.7)
    ),
    # ---- calibrators, running totals
    "calibrate_specificity": _sql(
        f"""SELECT 0.95::DOUBLE AS target_specificity, p.t AS calibrated_threshold, CAST(1 AS DOUBLE) - p.fpr AS actual_specificity,
  p.tpr AS sensitivity_at_threshold FROM (SELECT {_nearest(0.95)} AS p) c""",
        LABELED_POINTS,
    ),
    "calibrate_youden": _sql(
        """SELECT 'youden' AS method, threshold, tpr AS sensitivity, CAST(1 AS DOUBLE) - fpr AS specificity FROM c_roc
ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1""",
        LABELED_POINTS,
    ),
    "calibrate_three": _sql(
        f"""SELECT 0.95::DOUBLE AS target_specificity, CAST(1 AS DOUBLE) - p.fpr AS p_actual_specificity, p.tpr AS p_sensitivity,
  0.95::DOUBLE AS target_specificity_b, CAST(1 AS DOUBLE) - b.fpr AS b_actual_specificity, b.tpr AS b_sensitivity,
  -CASE WHEN p.t <= b.t THEN q85 ELSE p.t END AS p_threshold, -CASE WHEN p.t <= b.t THEN q15 ELSE b.t END AS b_threshold, p.t <= b.t AS adjusted
FROM (SELECT (SELECT {{'t': threshold, 'tpr': tpr, 'fpr': fpr}} FROM c_roc
      WHERE threshold >= (SELECT quantile_cont(x, 0.5) FROM fx_labeled) AND CAST(1 AS DOUBLE) - fpr >= 0.98::DOUBLE ORDER BY tpr DESC, threshold DESC LIMIT 1) AS p,
    {_nearest(0.95, 'threshold <= (SELECT quantile_cont(x, 0.5) FROM fx_labeled)')} AS b,
    (SELECT quantile_cont(x, 0.85) FROM fx_labeled) AS q85, (SELECT quantile_cont(x, 0.15) FROM fx_labeled) AS q15) c""",
        LABELED_POINTS,
    ),
    "calibrate_precision": _sql(
        """SELECT 'precision_sliding' AS method, 0.9::DOUBLE AS target_ppv, ppv AS actual_ppv, 0.9::DOUBLE AS target_npv, npv AS actual_npv,
  p_threshold, b_threshold, adjusted FROM p_t""",
        LABELED_POINTS,
        SLIDE.format(ppv="0.9::DOUBLE", npv="0.9::DOUBLE", src="fx_labeled"),
    ),
    "cumulative_ppv": _sql("SELECT x, tp, fp, CAST(tp AS DOUBLE) / (tp + fp) AS ppv FROM c_p", LABELED_POINTS),
    "cumulative_npv": _sql(
        """SELECT x, N - fp + neg AS tn, P - tp + pos AS fn, CAST(N - fp + neg AS DOUBLE) / ((N - fp + neg) + (P - tp + pos)) AS npv FROM c_p""",
        LABELED_POINTS,
    ),
    "exon_offsets": _sql("SELECT * FROM fx_exons"),
    # ---- derivation jobs
    "codons": _sql("SELECT transcript_id, CAST(codon_idx AS INT) AS codon_idx, codon FROM fx_codons"),
    "missense_snvs": _sql(
        "SELECT transcript_id, codon_idx, cds_pos, codon, ref_aa, alt_aa, CHROM, POS, REF, ALT FROM fx_placed_snvs"
    ),
    "generate_scores": _sql(f"SELECT {GENERATED} FROM fx_generated"),
    "score_rejects": _sql("SELECT transcript_id, 'no_cds' AS reason FROM fx_transcripts WHERE bare"),
    "resume_scores": _sql(f"SELECT {GENERATED} FROM fx_generated WHERE strand = '+'"),
    "union_scores": _sql(
        "SELECT transcript_id, count(*) AS n, CAST(sum(POS) AS BIGINT) AS pos_sum FROM fx_placed_snvs GROUP BY transcript_id"
    ),
    "upsert_mutations": _sql(
        """SELECT protein_id, protein_pos, alt_aa, arg_max(score, {'a': ord % 2, 'o': ord, 's': score}) AS score
FROM fx_mutations GROUP BY protein_id, protein_pos, alt_aa"""
    ),
    "run_benchmark": _sql(
        f"""SELECT 1 AS min_stars, 0.8::DOUBLE AS test_size, 0.95::DOUBLE AS target_specificity, (SELECT count(*) FROM s_split WHERE split = 'train') AS n_train,
  0 - (SELECT t FROM b_t) AS threshold, CAST(1 AS DOUBLE) - (SELECT fpr FROM b_t) AS actual_specificity, (SELECT tpr FROM b_t) AS sensitivity_at_threshold,
  (SELECT count(*) FROM s_test) AS n_test, {BINARY_METRICS}
FROM ({_binary_cells('s_test', 'x > (SELECT t FROM b_t)')}) b""",
        BENCH_SPLIT.format(frac=0.8),
        "s_train AS (SELECT *, CAST(0 AS DOUBLE) - score AS x FROM s_split WHERE split = 'train')",
        "s_test AS (SELECT *, CAST(0 AS DOUBLE) - score AS x FROM s_split WHERE split = 'test')",
        re.sub(r"\bc_", "t_", POINTS.replace("{src}", "s_train")),
        "b_t AS (SELECT threshold AS t, tpr, fpr FROM t_roc ORDER BY abs(CAST(1 AS DOUBLE) - fpr - 0.95::DOUBLE), threshold DESC LIMIT 1)",
        POINTS.replace("{src}", "s_test"),
    ),
    "run_benchmark_three": _sql(
        _three("s_test", "(SELECT p_threshold FROM p_t)", "(SELECT b_threshold FROM p_t)"),
        BENCH_SPLIT.format(frac=0.8),
        "s_train AS (SELECT *, CAST(0 AS DOUBLE) - score AS x FROM s_split WHERE split = 'train')",
        "s_test AS (SELECT *, CAST(0 AS DOUBLE) - score AS x FROM s_split WHERE split = 'test')",
        re.sub(r"\bc_", "t_", POINTS.replace("{src}", "s_train")),
        re.sub(r"\bc_", "t_", SLIDE.format(ppv="0.95::DOUBLE", npv="0.95::DOUBLE", src="s_train")),
        POINTS.replace("{src}", "s_test"),
    ),
    "score_sequences": _sql(
        f"""SELECT transcript_id AS protein_id, CAST(codon_idx AS INT) AS pos, aa AS ref_aa, {LOG_PROB_COLUMNS}
FROM (SELECT transcript_id, codon_idx, c.aa, ln(list_sum([exp(((codon_idx + 1) * i) % 13 / 4.0::DOUBLE) FOR i IN range(1, 21)])) AS z
  FROM fx_codons k JOIN fx_code c ON k.codon = c.codon) q"""
    ),
    "score_tolerant": _sql(
        """SELECT transcript_id AS protein_id, CASE WHEN bad THEN NULL ELSE n END AS n, CASE WHEN bad THEN NULL ELSE log_prob_sum END AS log_prob_sum,
  CASE WHEN bad THEN 'ValueError: doubled tryptophan' END AS reason
FROM (SELECT transcript_id, count(*) AS n, contains(string_agg(c.aa, '' ORDER BY codon_idx), 'WW') AS bad,
    CAST(sum(CAST(round(1000 * ((codon_idx + 1) % 13 / 4.0::DOUBLE - ln(list_sum([exp(((codon_idx + 1) * i) % 13 / 4.0::DOUBLE) FOR i IN range(1, 21)])))) AS BIGINT)) AS BIGINT) AS log_prob_sum
  FROM fx_codons k JOIN fx_code c ON k.codon = c.codon GROUP BY transcript_id) q"""
    ),
    "scan_vcf_members": _sql("SELECT CHROM, POS, '.' AS ID, REF, ALT, '.' AS QUAL, '.' AS FILTER, INFO FROM fx_clinvar"),
    "fasta_gz_chunks": _sql(
        f"""SELECT contig, bin, substr(seq, bin * {CHUNK} + 1, {CHUNK}) AS chunk
FROM (SELECT contig, seq, unnest(range(0, (length(seq) - 1) // {CHUNK} + 1)) AS bin FROM fx_contig) b"""
    ),
    "feature_ancestors": _deep("SELECT id, ancestor, CAST(min(hops) AS BIGINT) AS hops FROM paths GROUP BY id, ancestor"),
    "descendant_cds": _deep(
        """SELECT DISTINCT ancestor AS transcript_id, chrom, start_pos, end_pos, strand, '.' AS phase
FROM (SELECT c.*, c.parent AS ancestor FROM cds c UNION ALL SELECT c.*, p.ancestor FROM cds c JOIN paths p ON p.id = c.parent) q WHERE ancestor LIKE 'tx%' OR ancestor LIKE 'in%'"""
    ),
    "gene_cds": _deep(
        """SELECT ancestor AS gene_id, count(*) AS n, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS bases
FROM cds c JOIN paths p ON p.id = c.parent WHERE ancestor LIKE 'g%' GROUP BY ancestor"""
    ),
    "published_scores": _sql("SELECT * FROM fx_scores"),
    "batch_manifest": _sql(
        "SELECT CASE WHEN POS % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, count(*) AS n_rows FROM fx_scores GROUP BY batch"
    ),
}


def _report(fields, source, extra="0 AS unused"):
    """A report as JSON text over the rows of another query."""
    return f"SELECT {_json(fields)} AS value FROM (SELECT *, {extra} FROM ({ORACLES[source]}) r) q"


ORACLES |= {
    "report_nested": _report(_kinds("p_threshold b_threshold") | THREE_SECTIONS, "evaluate_three_class"),
    "report_binary": _report(
        _kinds("threshold") | {"metrics": _kinds("auc sensitivity specificity precision npv tp:i tn:i fp:i fn:i")},
        "evaluate_binary",
        "-10.0::DOUBLE AS threshold",
    ),
    "report_specificity": _report(
        _kinds("threshold threshold_negated specificity")
        | {"metrics": _kinds("target_specificity actual_specificity sensitivity_at_threshold")},
        "calibrate_specificity",
        "0 - calibrated_threshold AS threshold, calibrated_threshold AS threshold_negated, target_specificity AS specificity",
    ),
    "report_three_class": _report(
        _kinds("p_threshold b_threshold specificity specificity_b")
        | {"metrics": _kinds("target_specificity p_actual_specificity p_sensitivity target_specificity_b b_actual_specificity b_sensitivity adjusted:i")},
        "calibrate_three",
        "target_specificity AS specificity, target_specificity_b AS specificity_b",
    ),
    "report_precision": _report(
        _kinds("p_threshold b_threshold ppv_target npv_target")
        | {"metrics": _kinds("method:s target_ppv actual_ppv target_npv actual_npv adjusted:i")},
        "calibrate_precision",
        "target_ppv AS ppv_target, target_npv AS npv_target",
    ),
    "filter_counts": _sql(
        """SELECT count(*) AS total, count(*) FILTER (WHERE CLNSIG = 'Pathogenic') AS "Pathogenic",
  count(*) FILTER (WHERE CLNSIG = 'Likely_pathogenic') AS "Likely_pathogenic", count(*) FILTER (WHERE CLNSIG = 'Benign') AS "Benign",
  count(*) FILTER (WHERE CLNSIG = 'Likely_benign') AS "Likely_benign", (SELECT count(*) FROM fx_kept) AS kept FROM fx_annotated"""
    ),
    "filtered_vcf_file": ORACLES["filter_clinvar_lines"],
    "single_vcf_file": _sql("SELECT value FROM fx_vcf_lines"),
    "clustered_files": _sql(
        "SELECT CHROM, min(POS) AS min_pos, max(POS) AS max_pos, count(*) AS n_rows FROM fx_raw_scores GROUP BY CHROM"
    ),
    "clustered_interval": _sql("SELECT * FROM fx_scores WHERE CHROM = 'chr5' AND POS BETWEEN 2000 AND 40000"),
    "clustered_lookup": ORACLES["lookup_scores"],
    "sketch_percentiles": _sql(
        """SELECT CAST(q AS DOUBLE) AS q, count(x) > 0 AS all_rows, count(x) > 0 AS within
FROM fx_labeled, (VALUES (0.15), (0.2), (0.5), (0.8), (0.85)) v(q) GROUP BY q"""
    ),
    "lookup_scores_shuffled": ORACLES["lookup_scores"],
}
