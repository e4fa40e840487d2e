"""DuckDB SQL for the training-data queries that SQL can express.

Without SQL: op3 (merges), op5 (all pairs of lines are too slow), op8 (a fitted
model) and the pipeline; tests hold these against brute-force versions.
"""

from __future__ import annotations

from . import licenses, mixing, preference, quality_rules
from .common import LOWER, UPPER
from .queries import MAX_REPEATS, SHARD_BYTES

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_SPACED = "translate({}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     ')"
_WORDS = f"list_filter(string_split({_SPACED}, ' '), lambda x: x<>'')"
_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _without(line: str, chars: str) -> str:
    return f"translate({line}, {_text(chars)}, '')"


def _count(line: str, chars: str) -> str:
    return f"(length({line})-length({_without(line, chars)}))"


def _quality_rules() -> str:
    furniture = " OR ".join(f"contains({_LOW.format('l')}, {_text(p)})" for p in quality_rules.BOILERPLATE)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS w FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT rid, w, unnest(range(1, len(w)-1)) AS i FROM w)),
m AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid,a,b,c) AS k FROM g) WHERE k>1),
r AS (SELECT rid, CAST(sum(least(3, coalesce(nx-i,3))) AS BIGINT) AS n_repeat_words FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM m) GROUP BY rid),
x AS (SELECT w.rid, doc_id, t, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_repeat_words,0) AS n_repeat_words FROM w LEFT JOIN r ON w.rid=r.rid),
ln AS (SELECT rid, n_repeat_words, l, {_WORDS.format('l')} AS lw FROM (SELECT rid, n_repeat_words, unnest(string_split(t, chr(10))) AS l FROM x)),
j AS (SELECT rid, l, len(lw) AS n, (len(lw)<=2 AND NOT contains({_text(quality_rules.ENDS)}, right(rtrim(l),1)))
 OR {_count('l', quality_rules.SYMBOLS)}*100>len(lw)*40 OR ({_count('l', quality_rules.BARS)}*100>len(lw)*30 AND {_count('l', quality_rules.BARS)}>=2) OR {_count('l', '!')}*100>len(lw)*60
 OR (contains(l, {_text(quality_rules.LINK)}) AND (length(l)-length(replace(l, {_text(quality_rules.LINK)}, '')))*2>=len(lw)*{len(quality_rules.LINK)}) OR (n_repeat_words>=10 AND len(lw)>=12 AND len(list_distinct(lw))*4<=len(lw)) OR {furniture} AS bad FROM ln WHERE len(lw)>0),
s AS (SELECT rid, count(*)-count(DISTINCT l) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (NOT bad),0) AS BIGINT) AS kept_words FROM j GROUP BY rid),
f AS (SELECT x.*, n_words<{quality_rules.MIN_WORDS} OR 100*n_repeat_words>{quality_rules.REPEAT_PERCENT}*n_words AS base_failed, coalesce(n_dup_lines,0) AS n_dup_lines, coalesce(kept_words,0) AS kept_words FROM x LEFT JOIN s ON x.rid=s.rid)
SELECT doc_id, n_words, CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars, CAST({_count('t', quality_rules.SYMBOLS)} AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words-kept_words)*100<=n_words*{quality_rules.MAX_LOST_PERCENT} AS kept, kept_words FROM f"""


def _canonical(column: str) -> str:
    out = f"regexp_replace({_LOW.format(column)}, {_text(licenses._COPYRIGHT)}, ' ', 'g')"
    out = f"concat(' ', trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    for was, now in licenses.SPELLINGS:
        if was != now:
            out = f"replace({out}, {_text(f' {was} ')}, {_text(f' {now} ')})"
    return f"trim({out})"


def _license_scan() -> str:
    rows = ", ".join(f"({_text(key)}, {_text(text)})" for key, text in licenses.known())
    return f"""WITH known(license, t) AS (VALUES {rows}), k AS (SELECT md5({_canonical('t')}) AS digest, min(license) AS license FROM known GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents),
g AS (SELECT rid, t, regexp_split_to_array(t, {_text(licenses.GAP)}) AS g FROM d),
n AS (SELECT rid, t, array_to_string(g[i:i+k-1], chr(10)||chr(10)) AS u, k FROM (SELECT *, unnest(range(1, len(g)-k+2)) AS i FROM (SELECT *, unnest(range(1, least(len(g), {licenses.RUN})+1)) AS k FROM g WHERE len(g)>1))),
u AS (SELECT DISTINCT rid, u, u=t AS entire FROM (SELECT rid, t, unnest(list_append(string_split(t, chr(10)), t)) AS u FROM d UNION ALL SELECT rid, t, u FROM n WHERE k=1 OR length(u)>={licenses.RUN_CHARS})),
f AS (SELECT rid, max(license) FILTER (entire) AS whole, list_sort(list(DISTINCT license)) AS licenses FROM u JOIN k ON md5({_canonical('u')})=digest GROUP BY rid)
SELECT doc_id, whole, coalesce(array_to_string(licenses, ','),'') AS licenses, CAST(coalesce(len(licenses),0) AS BIGINT) AS n_licenses FROM d LEFT JOIN f ON d.rid=f.rid"""


_MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source,'') AS source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+'))+1 AS BIGINT) AS tokens, md5(coalesce(text,'')) AS t FROM documents),
tot AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source), b AS (SELECT CAST(sum(total) AS BIGINT) AS b FROM tot),
ps AS (SELECT list(total/b ORDER BY source) AS ps FROM tot, b),
bi(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i+1, CASE WHEN flat THEN (lo+hi)/2 ELSE lo END, CASE WHEN flat THEN hi ELSE (lo+hi)/2 END
 FROM (SELECT i, lo, hi, list_max(list_transform(ps, lambda p: pow(p,(lo+hi)/2)/list_sum(list_transform(ps, lambda q: pow(q,(lo+hi)/2)))/p)) > {MAX_REPEATS} AS flat FROM bi, ps WHERE i<{mixing.ROUNDS})),
a AS (SELECT CASE WHEN list_max(list_transform(ps, lambda p: 1.0/len(ps)/p)) > {MAX_REPEATS} THEN hi ELSE 0.0 END AS a FROM bi, ps WHERE i={mixing.ROUNDS}),
w AS (SELECT source, total, greatest(CAST(floor(pow(total/b,a)/(SELECT sum(pow(total/b,a)) FROM tot, b, a)*b) AS BIGINT),1) AS budget FROM tot, b, a),
n AS (SELECT *, greatest(ceil(sum(budget) OVER ()/{1 << 20}),1) AS blocks FROM w),
e AS (SELECT doc_id, source, tokens, t, total, budget, blocks, unnest(range(0, (budget-1)//total+1)) AS epoch FROM d JOIN n USING (source) WHERE budget>0),
h AS (SELECT *, CAST('0x'||substr(md5(concat_ws('|', epoch, doc_id, t)),1,8) AS BIGINT) AS h FROM e),
s AS (SELECT *, epoch*total+coalesce(sum(tokens) OVER (PARTITION BY source,epoch ORDER BY h,doc_id,t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS spent FROM h)
SELECT doc_id, source, epoch, CAST(floor(CAST(spent*blocks AS DOUBLE)/budget) AS BIGINT) AS block, tokens FROM s WHERE spent<budget"""

_SHARDING = f"""WITH d AS (SELECT doc_id, CAST('0x'||substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR),''), md5(coalesce(text,'')))),1,15) AS BIGINT) AS h, CAST(strlen(coalesce(text,'')) AS BIGINT) AS n_bytes FROM documents),
l AS (SELECT d.*, bits, h>>(60-bits) AS prefix FROM d, (SELECT unnest(range(0,25)) AS bits)),
s AS (SELECT bits, prefix, sum(n_bytes) AS b, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT * FROM s WHERE b>{SHARD_BYTES} AND n>1),
m AS (SELECT s.* FROM s LEFT JOIN o ON o.bits=s.bits-1 AND o.prefix=s.prefix>>1 WHERE (s.bits=0 OR o.bits IS NOT NULL) AND (s.b<={SHARD_BYTES} OR s.n=1))
SELECT doc_id, n_bytes, CASE WHEN l.bits>0 THEN lpad(to_base(l.prefix,2), CAST(l.bits AS INTEGER), '0') ELSE '' END AS shard, CAST(0 AS BIGINT) AS part, CAST(m.b AS BIGINT) AS shard_bytes, m.n AS shard_rows FROM l JOIN m ON l.bits=m.bits AND l.prefix=m.prefix"""

_TOPK = """WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(64*x)) AS v FROM f WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x)))=0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.v[1:least(len(q.v),len(c.v))], c.v[1:least(len(q.v),len(c.v))]),0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id%20=0 AND q.vec_id<>c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank<=20"""

_NGRAMS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text,'')"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w)=0 THEN [] WHEN len(w)<3 THEN [w] ELSE list_transform(range(1,len(w)-1), lambda i: w[i:i+2]) END) AS s FROM d)),
n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN g ON d.doc_id=g.doc_id GROUP BY d.doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s=y.s AND x.doc_id<y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*k>=90*(x.n+y.n-k)), e AS (SELECT a,b FROM l UNION SELECT b,a FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reached=e.a)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.node=n.doc_id GROUP BY n.doc_id, n.n"""


def _side(name: str, text: str) -> str:
    return f"""{name} AS (SELECT t.pair_id, list(struct_pack(role := role, text := txt) ORDER BY turn NULLS FIRST, role, txt) AS x FROM (SELECT t.pair_id, turn, role, {text} AS txt FROM t JOIN p ON t.pair_id=p.pair_id WHERE turn IS NULL OR turn<=last) t GROUP BY t.pair_id)"""


def _rendered(turns: str) -> str:
    return f"md5(coalesce(array_to_string(list_transform({turns}, lambda y: concat('<|', y.role, '|>', chr(10), y.text, '<|end|>', chr(10))), ''),''))"


def _mask(turns: str) -> str:
    run = "CASE WHEN y.role='assistant' THEN concat(length(y.role)+5, '+', length(y.text)+8) ELSE concat(length(y.role)+length(y.text)+13, '+0') END"
    return f"coalesce(array_to_string(list_transform({turns}, lambda y: {run}), ','),'')"


_PREFERENCE = f"""WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT pair_id, turn AS last, text AS reply FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC) AS k FROM t WHERE role='assistant') WHERE k=1),
w AS (SELECT *, md5(reply) AS rh, CAST('0x'||substr(md5(CAST(pair_id AS VARCHAR)),1,8) AS BIGINT) % (SELECT greatest(count(*)//{preference.DEAL},1) FROM la) AS b FROM la),
i AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY rh, pair_id)-1 AS i, count(*) OVER (PARTITION BY b) AS n, count(*) OVER (PARTITION BY b, rh) AS m FROM w),
j AS (SELECT *, min(i) OVER (PARTITION BY b, rh) AS g FROM i),
p AS (SELECT x.pair_id, x.last, y.reply AS other FROM j x JOIN j y ON y.b=x.b AND y.i=(x.g+x.m+(x.i-x.g)%(x.n-x.m))%x.n WHERE x.n>x.m),
{_side('a', 't.text')}, {_side('b', "CASE WHEN turn IS NOT DISTINCT FROM last AND role='assistant' THEN other ELSE t.text END")},
n AS (SELECT a.pair_id, a.x AS a, b.x AS b, list_min(list_filter(range(0, least(len(a.x),len(b.x))+1), lambda i: NOT coalesce(a.x[i+1]=b.x[i+1],false))) AS k FROM a JOIN b ON a.pair_id=b.pair_id)
SELECT pair_id, CAST(k AS INTEGER) AS n_common, {_rendered('a[1:k]')} AS prompt_md5, {_rendered('a[k+1:]')} AS chosen_md5, {_rendered('b[k+1:]')} AS rejected_md5, {_mask('a[k+1:]')} AS chosen_mask, {_mask('b[k+1:]')} AS rejected_mask FROM n"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op2_source_mixing": _MIXING,
    "op4_ngram_jaccard": _NGRAMS,
    "op6_sharding": _SHARDING,
    "op7_topk_search": _TOPK,
    "op9_preference_pairs": _PREFERENCE,
    "op10_quality_rules": _quality_rules(),
}
