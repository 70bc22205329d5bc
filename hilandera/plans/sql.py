"""SQL fragments (for DuckDB) that repeat the operators, to check the queries against."""

from __future__ import annotations

from hilandera import constants as C

_POINTS = "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in C.SPACE_POINTS)
_WORD = C.WORD_CHARS.replace("'", "''")
TOKEN = f"[{_WORD}]+|[{_POINTS}]+|[^{_WORD}{_POINTS}]+"
_QUOTES = "translate({0}, '‘’‚‛“”„‟', '''''''''\"\"\"\"')"


def words(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def tag_case(w: str, lexicon: bool = True) -> str:
    known = f"WHEN {hexa(w, 1)} < 8 AND {w} IN (SELECT word FROM vocabulary) THEN substr('nvar', ({hexa(w, 1)} % 4 + 1)::INT, 1) " if lexicon else ""
    cases = " ".join(f"WHEN length({w}) > {len(s)} AND ends_with({w}, '{s}') THEN '{t}'" for s, t in C.SUFFIXES)
    return f"CASE {known}{cases} ELSE 'n' END"


def hexa(w: str, at: int, digits: int = 1) -> str:
    return f"('0x' || substr(md5({w}), {at}, {digits}))::BIGINT"


def raw(source: str = "SELECT doc_id, text FROM documents WHERE lang = 'es'") -> str:
    """raw(doc_id, pos, raw, type) of the texts."""
    return f"""texts AS ({source}),
    lists AS (SELECT doc_id, regexp_extract_all({_QUOTES.format("text")}, '{TOKEN}') AS t FROM texts),
    places AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM lists),
    raw AS (SELECT doc_id, i - 1 AS pos, t[i] AS raw, CASE WHEN regexp_matches(t[i], '^[{_WORD}]') THEN 'w' WHEN regexp_matches(t[i], '^[{_POINTS}]')
      THEN CASE WHEN contains(t[i], chr(10) || chr(10)) OR contains(t[i], chr(13) || chr(10) || chr(13) || chr(10)) THEN 'p' ELSE 's' END ELSE 'x' END AS type FROM places)"""


#: low, tag, lemma without and with the synthetic lexicons.
VOCABULARY = "vocabulary AS (SELECT DISTINCT lower(raw) AS word FROM raw WHERE type = 'w')"
PLAIN = "tagged AS (SELECT *, lower(raw) AS low, 'n' AS tag, lower(raw) AS lemma FROM raw WHERE type = 'w')"
LEXICON = f"""{VOCABULARY},
    tags AS (SELECT word, {tag_case("word")} AS tag FROM vocabulary),
    lemmas AS (SELECT word, tag, CASE WHEN tag = 'v' AND ends_with(word, 'ó') AND length(word) > 2 THEN substr(word, 1, length(word) - 1) || 'ar'
      WHEN ends_with(word, 's') AND length(word) > 3 THEN substr(word, 1, length(word) - 1) ELSE word END AS lemma FROM tags),
    tagged AS (SELECT raw.*, word AS low, tag, lemma FROM raw JOIN lemmas ON lower(raw) = word WHERE type = 'w')"""
FLAGS = f"""flagged AS (SELECT *, low IN {words(C.NEGATION)} AS neg, (lemma IN {words(C.STOP_WORDS)} OR low IN {words(C.STOP_WORDS)} OR low IN {words(C.NEGATION)}) AS stop FROM tagged),
    content AS (SELECT doc_id, pos, lemma, tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS cpos FROM flagged WHERE NOT stop)"""
_KEY = "CASE WHEN regexp_full_match({0}, '0|[1-9][0-9]{{0,9}}') AND {0}::BIGINT < 4294967295 THEN {0}::BIGINT END"


def ranked(counts: str, item: str) -> str:
    key = _KEY.format(item)
    return f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, ({key}) IS NULL, {key}, first) AS rank FROM ({counts})"


FREQS = f"freqs AS ({ranked('SELECT doc_id, lemma, count(*) AS freq, min(cpos) AS first FROM content GROUP BY ALL', 'lemma')})"
TONE = f"""toned AS (SELECT *, CASE WHEN {hexa("lemma", 2)} < 12 THEN ({hexa("lemma", 3, 4)} / 65535 - 0.5) * 2 END AS p0, CASE WHEN {hexa("lemma", 2)} < 12 THEN {hexa("lemma", 7, 4)} / 65535 END AS arousal FROM flagged),
    scoped AS (SELECT *, sum(CASE WHEN stop THEN 0 ELSE 1 END) OVER w AS c FROM toned WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    scopes AS (SELECT *, last_value(CASE WHEN neg THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c0 FROM scoped),
    enriched AS (SELECT *, CASE WHEN NOT stop AND c - c0 BETWEEN 1 AND {C.NEGATION_SCOPE} THEN -p0 ELSE p0 END AS polarity FROM scopes)"""
EMOTIONS = {e: f"{hexa('lemma', 20 + i)} < 3" for i, e in enumerate(C.EMOTIONS)}
SEGMENTS = f"""segs AS (SELECT *, least(floor(cpos / greatest(floor((count(*) OVER (PARTITION BY doc_id)) / {C.SEGMENTS}), 1)), {C.SEGMENTS - 1})::BIGINT AS seg FROM content),
    seg_freq AS (SELECT doc_id, seg, word, freq, freq / sum(freq) OVER (PARTITION BY doc_id, seg) AS norm_freq FROM (SELECT doc_id, seg, lemma AS word, count(*) AS freq FROM segs GROUP BY ALL))"""
#: Edges between content lemmas, a node's tag being the lexicon's or the suffixes'.
GRAPH = f"""known AS (SELECT DISTINCT lemma FROM content),
    up AS (SELECT k.lemma AS src, substr(k.lemma, 3) AS dst FROM known k SEMI JOIN known o ON substr(k.lemma, 3) = o.lemma WHERE length(k.lemma) >= 5),
    part AS (SELECT k.lemma AS src, substr(k.lemma, 1, length(k.lemma) - 2) AS dst FROM known k SEMI JOIN known o ON substr(k.lemma, 1, length(k.lemma) - 2) = o.lemma WHERE length(k.lemma) >= 5),
    edges AS (SELECT *, row_number() OVER (PARTITION BY src, rel_ord ORDER BY dst) - 1 AS ord FROM (
      SELECT src, dst, 0 AS rel_ord, 'hyp↑' AS label FROM up UNION ALL SELECT dst, src, 1, 'hyp↓' FROM up UNION ALL SELECT src, dst, 2, 'mer' FROM part)),
    links AS (SELECT DISTINCT src, dst FROM edges)"""


def reach(starts: str, depth: int) -> str:
    """reach(seed, target, h): fewest hops."""
    steps = ["hop0 AS (SELECT DISTINCT seed, seed AS node FROM (" + starts + "))"]
    for h in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM hop{k}" for k in range(h))
        steps.append(f"hop{h} AS (SELECT DISTINCT f.seed, l.dst AS node FROM hop{h - 1} f JOIN links l ON f.node = l.src ANTI JOIN ({seen}) s ON f.seed = s.seed AND l.dst = s.node)")
    union = " UNION ALL ".join(f"SELECT seed, node AS target, {h} AS h FROM hop{h}" for h in range(1, depth + 1))
    return ", ".join(steps) + f", reach AS ({union})"


def query(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


SEEDS = "seeds AS (SELECT lemma AS word, row_number() OVER (ORDER BY n DESC, lemma) AS ord FROM (SELECT lemma, count(*) AS n FROM content WHERE length(lemma) >= 7 GROUP BY 1) ORDER BY 2 LIMIT 6)"
EXPAND = """exp1 AS (SELECT s.word AS seed, e.dst AS word, min([e.rel_ord, e.ord]) AS key, arg_min(e.label, [e.rel_ord, e.ord]) AS rel, 1 AS dist FROM seeds s JOIN edges e ON e.src = s.word WHERE e.dst <> s.word GROUP BY ALL HAVING true),
    exp2 AS (SELECT x.seed, e.dst AS word, arg_min(e.label, list_concat(x.key, [e.rel_ord, e.ord])) AS rel, 2 AS dist FROM exp1 x JOIN edges e ON e.src = x.word
      ANTI JOIN (SELECT seed, word FROM exp1 UNION ALL SELECT word, word FROM seeds) s ON s.seed = x.seed AND s.word = e.dst GROUP BY x.seed, e.dst),
    expansions AS (SELECT f.doc_id, x.seed, x.word, x.rel, x.dist FROM (SELECT seed, word, rel, dist FROM exp1 UNION ALL SELECT * FROM exp2) x JOIN freqs f ON f.lemma = x.seed JOIN freqs g ON g.doc_id = f.doc_id AND g.lemma = x.word),
    terms AS (SELECT doc_id, seed, word, rel, dist FROM expansions UNION ALL SELECT doc_id, word, word, 'seed', 0 FROM freqs JOIN seeds ON lemma = word)"""
CELLS = f"""tw AS (SELECT DISTINCT doc_id, word FROM terms),
    inside AS (SELECT c.doc_id, cpos, lemma FROM content c SEMI JOIN tw ON tw.doc_id = c.doc_id AND tw.word = c.lemma),
    together AS (SELECT x.doc_id, x.lemma AS a, y.lemma AS b, count(*) AS n FROM inside x JOIN inside y ON x.doc_id = y.doc_id AND y.cpos BETWEEN x.cpos - {C.WINDOW} AND x.cpos + {C.WINDOW} AND x.cpos <> y.cpos GROUP BY ALL),
    act AS (SELECT f.doc_id, f.lemma AS a, r.target AS b, f.freq * power({C.DECAY}, r.h) AS s FROM freqs f JOIN reach r ON r.seed = f.lemma AND r.h <= {C.DEPTH}),
    cells AS (SELECT x.doc_id, x.word AS a, y.word AS b, coalesce(n, 0) AS cooc, greatest(coalesce(p.s, 0), coalesce(q.s, 0)) AS activ,
      CASE WHEN x.word = y.word THEN 1.0 WHEN r.h IS NULL THEN 0.0 ELSE 1 / (1 + r.h) END AS prox
      FROM tw x JOIN tw y ON x.doc_id = y.doc_id LEFT JOIN together t ON t.doc_id = x.doc_id AND t.a = x.word AND t.b = y.word
      LEFT JOIN act p ON p.doc_id = x.doc_id AND p.a = x.word AND p.b = y.word LEFT JOIN act q ON q.doc_id = x.doc_id AND q.a = y.word AND q.b = x.word
      LEFT JOIN reach r ON r.seed = x.word AND r.target = y.word)"""
