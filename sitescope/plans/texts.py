"""Queries over texts: brief checks, style and task texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import words as W
from sitescope.operators import briefs as B
from sitescope.operators import texts as T
from sitescope.plans import fixture as X
from sitescope.sources.tables import settled

#: The rules of the registered checks; phrases that occur in the given texts.
MARKERS = (("of the", "cliche", "medium"), ("with", "abstract", "low"), ("and the", "template", "low"))
CONNECTORS = ("for", "and the", "de la")
STOP = ("the", "of", "and", "to", "in", "is", "de", "la")


def docs(s, d):
    return X.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def briefed(s, d):
    return X.derive(s, d, X.BRIEFED, "documents", "benchmark")


def requirements(s, d):
    return X.derive(s, d, X.REQUIREMENTS, "benchmark", "nation")


def hits(s, d):
    return B.independent(B.matches(briefed(s, d), requirements(s, d)))


def sentences(s, d):
    return T.sentences(docs(s, d))


def t01_blank_lines(s, d):
    rows = docs(s, d).withColumn("text", F.concat(F.regexp_replace("text", r"\n", "\n \n\n"), F.lit("\n")))
    return rows.select("doc_id", F.sha2(W.drop_blank_lines("text"), 256).alias("sha"))


def t02_normal_words(s, d):
    w = docs(s, d).select(F.explode(F.split("text", r"\s+")).alias("word"))
    return w.select(W.normal("word").alias("norm")).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def russian(s, d):
    return X.derive(s, d, X.RUSSIAN, "documents")


def t03_stems(s, d):
    return W.stems(russian(s, d).select(F.explode(T.words("text")).alias("word")))


def t04_tokens(s, d):
    return W.tokenize(docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.max("end").cast("long").alias("last_end"), F.max("sentence").cast("long").alias("sentences"))


def t05_phrase_matches(s, d):
    return B.matches(briefed(s, d), requirements(s, d)).select("doc_id", "brief_id", "requirement", "first", "last", "exact", "start", "end", "sentence")


def t06_independent_matches(s, d):
    return hits(s, d).select("doc_id", "brief_id", "requirement", "first", "last")


def t07_keyword_status(s, d):
    return B.keyword_status(briefed(s, d), requirements(s, d), hits(s, d)).drop("version")


def t08_spacing(s, d):
    return B.spacing(hits(s, d)).drop("version")


def _coverage(s, d):
    wanted = X.derive(s, d, X.LSI, "benchmark", "nation")
    return B.coverage(briefed(s, d), wanted, B.matches(briefed(s, d), wanted))


def t09_coverage(s, d):
    return _coverage(s, d).drop("version")


def _volume(s, d):
    return B.volume(briefed(s, d), X.derive(s, d, X.TARGETS, "benchmark"))


def t10_readiness(s, d):
    claimed = settled(hits(s, d))
    status = B.keyword_status(briefed(s, d), requirements(s, d), claimed)
    return B.readiness(status, B.spacing(claimed), _coverage(s, d), _volume(s, d)).drop("version")


def t10_volume(s, d):
    return _volume(s, d).drop("version")


def t11_snippets(s, d):
    return docs(s, d).select("doc_id", T.snippet(F.col("text"), F.lit(100), F.lit(120), 30).alias("snippet"))


def t12_briefs(s, d):
    b = T.parse_briefs(X.derive(s, d, X.BRIEFS, "benchmark"))
    return b.select("brief_id", "url", "words", "chars", F.size("keywords").alias("n_keys"), F.get("keywords", F.lit(0))["phrase"].alias("first_key"), F.element_at("keywords", -1)["phrase"].alias("last_key"), F.element_at("keywords", -1)["max"].alias("last_max"), F.array_join("lsi", ",").alias("lsi"), "main_keyword", F.array_join("additional", ",").alias("additional"))


def t13_sentences(s, d):
    return sentences(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest"))


def t14_markers(s, d):
    return T.marker_hits(docs(s, d), s.createDataFrame(MARKERS, "marker string, title string, severity string"))


def t15_openers(s, d):
    return T.repeated_openers(sentences(s, d), ("the", "la"))


def t16_similar_neighbours(s, d):
    return T.neighbour_similarity(russian(s, d), STOP)


def t17_rhythm(s, d):
    return T.rhythm(sentences(s, d))


def t18_connectors(s, d):
    return T.connectors(docs(s, d), CONNECTORS)


def t19_tone(s, d):
    return T.tone(docs(s, d).withColumn("text", F.translate("text", ".", "!")))


def t20_verb_forms(s, d):
    return T.verb_forms(docs(s, d), (r"[a-z]{4,}ing\b", r"[a-z]{4,}ed\b"))


def t21_dashes(s, d):
    return T.dashes(docs(s, d).withColumn("text", F.regexp_replace("text", "[.] ", " — ")))


def t22_repeated_grams(s, d):
    return T.repeated_gram(docs(s, d), ("of the and",), STOP)


def t23_paragraphs(s, d):
    return T.paragraph_regularity(docs(s, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n")))


def _findings(s, d):
    return t14_markers(s, d).unionByName(t15_openers(s, d)).unionByName(t17_rhythm(s, d)).unionByName(t18_connectors(s, d))


def t24_style_result(s, d):
    return T.style_result(docs(s, d), _findings(s, d))


def t25_protected(s, d):
    return hits(s, d).select("doc_id", "brief_id", "requirement", "start", "end", "exact")


def _tasks(s, d):
    return X.derive(s, d, X.TASK_TEXTS, "documents", "customer")


def t26_task_facts(s, d):
    facts = T.task_facts(_tasks(s, d), X.derive(s, d, X.PROJECTS, "customer"))
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, r"\|")), "|")
    return facts.withColumn("urls", ordered("urls")).withColumn("relative_urls", ordered("relative_urls"))


def t27_task_lines(s, d):
    return T.task_lines(_tasks(s, d))


def t27_task_groups(s, d):
    return T.task_groups(T.task_lines(_tasks(s, d)))


def t27_checklist(s, d):
    return T.checklist(_tasks(s, d))


def t28_resolved_urls(s, d):
    t = docs(s, d).select("doc_id", (F.col("doc_id") % 2000).alias("project_id"), F.array(F.lit("https://e.example/")).alias("absolute"), F.array(F.lit("/a"), F.lit("/b"), F.lit("/a")).alias("relative"))
    return T.resolve_urls(t, X.derive(s, d, X.PROJECTS, "customer"))


_ALL = (t01_blank_lines, t02_normal_words, t03_stems, t04_tokens, t05_phrase_matches, t06_independent_matches, t07_keyword_status, t08_spacing, t09_coverage, t10_readiness, t10_volume, t11_snippets, t12_briefs, t13_sentences, t14_markers, t15_openers, t16_similar_neighbours, t17_rhythm, t18_connectors, t19_tone, t20_verb_forms, t21_dashes, t22_repeated_grams, t23_paragraphs, t24_style_result, t25_protected, t26_task_facts, t27_task_lines, t27_task_groups, t27_checklist, t28_resolved_urls)
QUERIES = {f.__name__: f for f in _ALL}

_DOC = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_W = "[A-Za-zА-Яа-яЁё0-9]+(?:[-–—][A-Za-zА-Яа-яЁё0-9]+)*"
_EDGE = "-–—_./\\''\"«»()[]{}"
_NORMED = lambda x: f"trim(replace(lower({x}), 'ё', 'е'), '{_EDGE}')"
_CLEAN = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_SENT = f"""sent AS (SELECT doc_id, pos - 1 AS pos, {_CLEAN('s')} AS sentence, len(regexp_extract_all(s, '{_W}')) AS n_words FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)'), 1) AS pos FROM ({_DOC}) d) x WHERE len(regexp_extract_all(s, '{_W}')) > 0)"""
_SEV = "CASE WHEN n >= 3 AND severity = 'low' THEN 'medium' WHEN n >= 3 AND severity = 'medium' THEN 'high' ELSE severity END"
_OPEN = f"""op AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(sentence, '{_W}')[1:2], lambda x: {_NORMED('x')}), ' ') AS opener, {_NORMED(f"regexp_extract_all(sentence, '{_W}')[1]")} AS first FROM sent)"""
# pieces of a text: words, sentence ends, and single other characters; so words have offsets and sentences
_TOK = f"""pc AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{_W}|[.!?…]+|(?s:.)') AS p FROM ({_DOC}) d) x),
  pl AS (SELECT *, sum(length(piece)) OVER w AS stop, sum(CAST(regexp_matches(piece, '^[.!?…]+$') AS INT)) OVER w AS sentence, regexp_matches(piece, '^[A-Za-zА-Яа-яЁё0-9]') AS isw FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
  tk AS (SELECT doc_id, {_NORMED('piece')} AS norm, CAST(stop - length(piece) AS INT) AS start, CAST(stop AS INT) AS stop, CAST(sentence AS INT) AS sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS idx FROM pl WHERE isw),
  t3 AS (SELECT *, lead(norm) OVER w AS n2, lead(norm, 2) OVER w AS n3, lead(sentence) OVER w AS s2, lead(sentence, 2) OVER w AS s3, lead(stop) OVER w AS e2, lead(stop, 2) OVER w AS e3 FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""
# longer phrases claim their words first: a brief's phrases take turns by length and place in the brief
_BRIEFED = X.sql(X.BRIEFED)
_MATCHED = lambda asked: f"""pw AS (SELECT brief_id, requirement, len(p) AS size, unnest(p) AS asked, unnest(range(len(p))) AS o FROM (SELECT brief_id, requirement, list_transform(regexp_extract_all(phrase, '{_W}'), lambda x: {_NORMED('x')}) AS p FROM ({X.sql(asked)}) q) r),
  ow AS (SELECT doc_id, brief_id FROM ({_BRIEFED}) b),
  mt AS (SELECT tk.doc_id, ow.brief_id, requirement, size, CAST(idx - o AS INT) AS first, CAST(max(idx) AS INT) AS last, min(start) AS start, max(stop) AS stop, min(sentence) AS sentence FROM tk JOIN ow ON ow.doc_id = tk.doc_id JOIN pw ON pw.brief_id = ow.brief_id AND pw.asked = tk.norm
    GROUP BY tk.doc_id, ow.brief_id, requirement, size, idx - o HAVING count(*) = size AND min(sentence) = max(sentence))"""  # noqa: E731
_CLAIMED = "".join(
    f""", n{k} AS (SELECT m.* FROM rk m WHERE turn = {k}{f" AND NOT EXISTS (SELECT 1 FROM c{k - 1} c WHERE c.doc_id = m.doc_id AND c.first <= m.last AND m.first <= c.last)" if k > 1 else ""}),
  c{k} AS ({f"SELECT * FROM c{k - 1} UNION ALL " if k > 1 else ""}SELECT * FROM n{k})""" for k in range(1, 6)
)
_HITS = f"""WITH {_TOK}, {_MATCHED(X.REQUIREMENTS)},
  tn AS (SELECT brief_id, requirement, row_number() OVER (PARTITION BY brief_id ORDER BY size DESC, requirement) AS turn FROM (SELECT DISTINCT brief_id, requirement, size FROM pw) t),
  rk AS (SELECT mt.*, turn FROM mt JOIN tn USING (brief_id, requirement)){_CLAIMED}, hit AS (SELECT * FROM c5) """
_COUNTED = lambda asked, found: f"SELECT o.doc_id, o.brief_id, q.*, coalesce(n, 0) AS n FROM ({_BRIEFED}) o JOIN (SELECT brief_id AS b, * EXCLUDE (brief_id) FROM ({X.sql(asked)}) y) q ON q.b = o.brief_id LEFT JOIN (SELECT doc_id AS i, requirement AS r, count(*) AS n FROM {found} GROUP BY 1, 2) f ON f.i = o.doc_id AND f.r = q.requirement"
_STATUS = f"""SELECT doc_id, brief_id, requirement, phrase, n, CASE WHEN n < "min" THEN 'missing' WHEN n > "max" THEN 'excess' ELSE 'ok' END AS status, CAST(CASE WHEN n < "min" THEN "min" - n WHEN n > "max" THEN n - "max" ELSE 0 END AS BIGINT) AS delta FROM ({_COUNTED(X.REQUIREMENTS, 'hit')}) z"""
_GAPS = """SELECT doc_id, brief_id, pb AS "left", requirement AS "right", CAST(greatest(0, first - lb - 1) AS BIGINT) AS gap FROM (SELECT *, lag(last) OVER w AS lb, lag(sentence) OVER w AS sb, lag(requirement) OVER w AS pb FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY first, last)) g WHERE sentence = sb AND first - lb - 1 < 2"""
_COVER = f"WITH {_TOK}, {_MATCHED(X.LSI)} SELECT doc_id, brief_id, requirement, phrase, n, n > 0 AS found FROM ({_COUNTED(X.LSI, 'mt')}) z"
_VOLUME = f"""SELECT doc_id, brief_id, n AS n_words, c AS n_chars, words - n AS word_delta, chars - c AS char_delta, coalesce(n < greatest(1, CAST(floor(words * 0.85) AS BIGINT)), false) AS too_short
  FROM (SELECT doc_id, o.brief_id, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS n, length({_CLEAN("coalesce(text, '')")}) AS c, words, chars FROM ({_BRIEFED}) o LEFT JOIN ({X.sql(X.TARGETS)}) g ON g.brief_id = o.brief_id) v"""
# word borders by a doubled character between words, as each border is then met from one side
_LOW = f"low AS (SELECT doc_id, ' ' || regexp_replace({_NORMED('text')}, '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\1', 'g') || ' ' AS low FROM ({_DOC}) d)"
_TIMES = lambda m: f"len(regexp_extract_all(low, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]{m.replace(' ', '  ')}[^\\p{{L}}\\p{{M}}\\p{{N}}_]'))"
_MARKS = " UNION ALL ".join(f"SELECT doc_id, '{t}:{m}' AS title, '{t}' AS t, '{v}' AS severity, {_TIMES(m)} AS n FROM low" for m, t, v in MARKERS)
_F14 = f"SELECT doc_id, 'marker' AS kind, {_SEV} AS severity, title, n FROM ({_MARKS}) m WHERE n > 0 AND (t NOT IN ({', '.join(repr(c) for c in T.COMMON)}) OR n >= 2)"
_F18 = " UNION ALL ".join(f"SELECT doc_id, 'repetition' AS kind, 'medium' AS severity, 'connector:{w}' AS title, {_TIMES(w)} AS n FROM low WHERE {_TIMES(w)} >= 3" for w in CONNECTORS)


def _ending_off(x, after_a, free):
    """The text without the longest ending of a group that it bears; some count only after certain letters."""
    every = {e: True for e in after_a.split()} | {e: False for e in free.split()}
    rest = lambda e: f"left({x}, length({x}) - {len(e)})"
    cases = "".join(f" WHEN ends_with({x}, '{e}') THEN " + (f"CASE WHEN regexp_matches({rest(e)}, '[ая]$') THEN {rest(e)} ELSE {x} END" if bound else rest(e)) for e, bound in sorted(every.items(), key=lambda i: -len(i[0])))
    return f"CASE{cases} ELSE {x} END"


#: The stemmer in SQL, step by step, over the distinct words (w) of a table: stem of each.
_STEMMED = lambda source: f"""sw AS (SELECT DISTINCT w, {_NORMED('w')} AS n FROM {source}), s1 AS (SELECT w, n, regexp_extract(n, '^[^{W.VOWELS}]*[{W.VOWELS}]') AS head FROM sw),
  s2 AS (SELECT *, substr(n, length(head) + 1) AS r, length(n) > 3 AND regexp_matches(n, '[а-я]') AND head <> '' AND length(n) > length(head) AS fit FROM s1), s3 AS (SELECT *, {_ending_off('r', *W.PERFECTIVE_GERUND)} AS g, {_ending_off('r', *W.REFLEXIVE)} AS f FROM s2),
  s4 AS (SELECT *, {_ending_off('f', *W.ADJECTIVE)} AS aj, {_ending_off('f', *W.VERB)} AS vb, {_ending_off('f', *W.NOUN)} AS nn FROM s3), s5 AS (SELECT *, {_ending_off('aj', *W.PARTICIPLE)} AS pt FROM s4),
  s6 AS (SELECT *, CASE WHEN g <> r THEN g WHEN aj <> f THEN pt WHEN vb <> f THEN vb ELSE nn END AS i FROM s5), s7 AS (SELECT *, regexp_replace(regexp_replace(i, 'и$', ''), 'ость?$', '') AS j FROM s6),
  s8 AS (SELECT *, head || regexp_replace(regexp_replace(regexp_replace(j, 'ейше$', ''), 'нн$', 'н'), 'ь$', '') AS short FROM s7), stm AS (SELECT w, CASE WHEN fit AND length(short) >= 3 THEN short ELSE n END AS stem FROM s8)"""  # noqa: E731
_SENT_RU = _SENT.replace(f"FROM ({_DOC}) d)", f"FROM ({X.sql(X.RUSSIAN)}) d)")
_NEAR = f"""vw AS (SELECT {_NORMED('w')} AS w FROM (SELECT unnest(regexp_extract_all(sentence, '{_W}')) AS w FROM sent) q), {_STEMMED('vw')},
  cw AS (SELECT DISTINCT doc_id, pos, stem FROM (SELECT doc_id, pos, unnest(list_transform(regexp_extract_all(sentence, '{_W}'), lambda x: {_NORMED('x')})) AS w FROM sent) q JOIN stm USING (w) WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{x}'" for x in STOP)}) AND NOT regexp_matches(w, '^[0-9]+$') AND length(stem) >= 3),
  st AS (SELECT s.doc_id, s.pos, coalesce(list(stem) FILTER (WHERE stem IS NOT NULL), []) AS stems FROM sent s LEFT JOIN cw ON cw.doc_id = s.doc_id AND cw.pos = s.pos GROUP BY 1, 2),
  nb AS (SELECT doc_id, pos, len(stems) AS a, len(after) AS b, len(list_intersect(stems, after)) AS same FROM (SELECT *, lead(stems) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM st) z WHERE after IS NOT NULL)"""
_TASK = X.sql(X.TASK_TEXTS)
_HOLDS = lambda words, x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_WORDS_CASE = lambda table, x, other: "CASE " + " ".join(f"WHEN {_HOLDS(w, x)} THEN '{n}'" for n, w in table) + (f" ELSE '{other}'" if other else "") + " END"
_LINES = f"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM ({_TASK}) t),
  l1 AS (SELECT doc_id, pos, regexp_matches(trim(raw), '^\\d+[.)]\\s*.+$') AS numbered, trim(regexp_replace(regexp_replace(trim(raw), '^\\d+[.)]\\s*', ''), '\\s+', ' ', 'g'), ' •*-—;,.') AS line FROM l0),
  l2 AS (SELECT *, lower(line) AS low, {_WORDS_CASE(T.ROLES, 'lower(line)', None)} AS led FROM l1 WHERE line <> ''),
  l3 AS (SELECT *, CASE WHEN starts_with(low, 'цели тз') OR starts_with(low, 'цель тз') THEN 'goals' WHEN starts_with(low, 'ожидаемый результат') THEN 'expected' WHEN led IS NOT NULL AND (starts_with(low, 'задач') OR contains(low, 'для ')) THEN 'tasks' END AS heading FROM l2),
  l4 AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER w, 'context') AS section, coalesce(last_value(CASE WHEN heading = 'tasks' THEN led END IGNORE NULLS) OVER w, '{T.COMMON_ROLE}') AS role, count(heading) OVER w AS part,
    heading IS NULL AND regexp_matches(low, '[.](xlsx|xls|pdf|docx)$') AS reference FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  l5 AS (SELECT *, CAST(free AND (numbered OR ((section = 'tasks' OR coalesce(bool_or(free AND numbered) OVER b, false)) AND ends_with(line, ':') AND NOT regexp_matches(low, '^(проблема|решение|пример):'))) AS INT) AS opens
    FROM (SELECT *, heading IS NULL AND NOT reference AND section IN ('context', 'tasks') AS free FROM l4) x WINDOW b AS (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l6 AS (SELECT *, CASE WHEN inside AND kind IN ('task', 'problem', 'solution', 'subtask', 'note') THEN CAST(number AS BIGINT) END AS task, {_WORDS_CASE(T.CATEGORIES, 'low', T.COMMON_CATEGORY)} AS category,
    CASE WHEN kind IN ('problem', 'solution') OR heading = 'expected' THEN trim(regexp_replace(line, '^[^:]*:', '')) WHEN kind = 'task' THEN rtrim(line, ':') ELSE line END AS shown FROM (
    SELECT * REPLACE (CASE WHEN kind = 'note' AND NOT inside AND line = title THEN 'title' ELSE kind END AS kind) FROM (SELECT *, min_by(line, pos) FILTER (WHERE regexp_matches(low, '^(тз( |№)|техническое задание)')) OVER (PARTITION BY doc_id) AS title, CASE WHEN heading IS NOT NULL THEN 'heading' WHEN reference THEN 'reference' WHEN section = 'goals' THEN 'goal' WHEN section = 'expected' THEN 'result' WHEN opens = 1 THEN 'task' WHEN NOT inside THEN 'note'
      WHEN starts_with(low, 'проблема:') THEN 'problem' WHEN starts_with(low, 'решение:') THEN 'solution' WHEN starts_with(low, 'пример:') THEN 'note' WHEN {' OR '.join(f"starts_with(low, '{a}')" for a in T.ACTIONS)} THEN 'subtask' ELSE 'note' END AS kind
    FROM (SELECT *, max(opens) OVER (PARTITION BY doc_id, part ORDER BY pos) = 1 AS inside, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM l5) y) k) z) """
ORACLE_SQL = {
    "t01_blank_lines": f"SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))) AS sha FROM ({_DOC}) d",
    "t02_normal_words": f"SELECT {_NORMED('w')} AS norm, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM ({_DOC}) d) x GROUP BY 1",
    "t03_stems": f"WITH rw AS (SELECT unnest(regexp_extract_all(text, '{_W}')) AS w FROM ({X.sql(X.RUSSIAN)}) d), {_STEMMED('rw')} SELECT w AS word, stem FROM stm",
    "t04_tokens": f"WITH {_TOK} SELECT doc_id, count(*) AS tokens, CAST(max(stop) AS BIGINT) AS last_end, CAST(max(sentence) AS BIGINT) AS sentences FROM tk GROUP BY 1",
    "t05_phrase_matches": f'WITH {_TOK}, {_MATCHED(X.REQUIREMENTS)} SELECT doc_id, brief_id, requirement, first, last, true AS exact, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", CAST(sentence AS INT) AS sentence FROM mt',
    "t06_independent_matches": _HITS + "SELECT doc_id, brief_id, requirement, first, last FROM hit",
    "t07_keyword_status": _HITS + _STATUS,
    "t08_spacing": _HITS + _GAPS,
    "t09_coverage": _COVER,
    "t10_readiness": _HITS + f""", al AS (SELECT doc_id, brief_id, CASE status WHEN 'missing' THEN delta ELSE 0 END AS missing, CASE status WHEN 'excess' THEN delta ELSE 0 END AS excess, 0 AS spacing, 0 AS missing_lsi, 0 AS short FROM ({_STATUS}) s
        UNION ALL SELECT doc_id, brief_id, 0, 0, 1, 0, 0 FROM ({_GAPS}) g UNION ALL SELECT doc_id, brief_id, 0, 0, 0, CAST(NOT found AS INT), 0 FROM ({_COVER}) c UNION ALL SELECT doc_id, brief_id, 0, 0, 0, 0, CAST(too_short AS INT) FROM ({_VOLUME}) v),
      su AS (SELECT doc_id, brief_id, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(excess) AS BIGINT) AS excess, CAST(sum(spacing) AS BIGINT) AS spacing, CAST(sum(missing_lsi) AS BIGINT) AS missing_lsi, sum(short) AS short FROM al GROUP BY 1, 2),
      iss AS (SELECT *, list_filter([CASE WHEN missing > 0 THEN 'missing' END, CASE WHEN excess > 0 THEN 'excess' END, CASE WHEN spacing > 0 THEN 'spacing' END, CASE WHEN missing_lsi > 0 THEN 'lsi' END, CASE WHEN short > 0 THEN 'short' END], lambda x: x IS NOT NULL) AS i FROM su)
      SELECT doc_id, brief_id, missing, excess, spacing, missing_lsi, array_to_string(i, ',') AS issues, len(i) = 0 AS ready FROM iss""",
    "t14_markers": f"WITH {_LOW} {_F14}",
    "t16_similar_neighbours": f"WITH {_SENT_RU}, {_NEAR}, sc AS (SELECT doc_id, pos, CASE WHEN a < 3 OR b < 3 THEN 0.0 ELSE greatest(same / CAST(a + b - same AS DOUBLE), 0.86 * same / least(a, b)) END AS score FROM nb) SELECT doc_id, pos, round(score, 4) AS score FROM sc WHERE round(score, 4) >= 0.56 AND score >= 0.56",
    "t18_connectors": f"WITH {_LOW} {_F18}",
    "t20_verb_forms": f"SELECT doc_id, 'syntax' AS kind, CASE WHEN n < 6 THEN 'medium' ELSE 'high' END AS severity, 'verb_forms' AS title, n FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-z]{{4,}}ing\\b')) + len(regexp_extract_all(text, '[a-z]{{4,}}ed\\b')) AS n FROM ({_DOC}) d) q WHERE n >= 3",
    "t24_style_result": f"""WITH {_SENT}, {_LOW}, {_OPEN}, p AS (SELECT doc_id, count(*) AS n, stddev_pop(n_words) AS sd, count(*) FILTER (WHERE n_words >= 30) AS l FROM sent GROUP BY 1),
      fi AS (SELECT doc_id, severity, title, n FROM ({_F14}) a UNION ALL SELECT doc_id, severity, title, n FROM ({_F18}) b UNION ALL SELECT doc_id, 'medium', 'opener:' || opener, count(*) FROM op GROUP BY doc_id, opener, first HAVING count(*) >= 3 OR (count(*) >= 2 AND first IN ('the', 'la'))
        UNION ALL SELECT doc_id, 'medium', 'even_rhythm', 1 FROM p WHERE n >= 5 AND sd < 4 UNION ALL SELECT doc_id, 'medium', 'long_sentences', l FROM p WHERE l > 0),
      un AS (SELECT DISTINCT * FROM fi), ag AS (SELECT doc_id, sum(CASE severity WHEN 'high' THEN 11 WHEN 'medium' THEN 7 ELSE 3 END) AS cost, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
        array_to_string(list_transform(list_sort(list({{'r': CASE severity WHEN 'high' THEN 0 ELSE 1 END, 't': title}}) FILTER (WHERE severity <> 'low'))[1:8], lambda x: x.t), '|') AS rewrite_first FROM un GROUP BY 1)
      SELECT d.doc_id, CAST(greatest(0, 100 - coalesce(cost, 0)) AS BIGINT) AS score, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(rewrite_first, '') AS rewrite_first FROM ({_DOC}) d LEFT JOIN ag ON ag.doc_id = d.doc_id""",
    "t25_protected": _HITS + 'SELECT doc_id, brief_id, requirement, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", true AS exact FROM hit',
    "t10_volume": _VOLUME,
    "t11_snippets": f"SELECT doc_id, '…' || {_CLEAN('substr(text, 71, greatest(0, least(length(text), 150) - 70))')} || CASE WHEN least(length(text), 150) < length(text) THEN '…' ELSE '' END AS snippet FROM ({_DOC}) d",
    "t12_briefs": """SELECT item_id AS brief_id, 'https://e.example/p' || item_id % 9 AS url, 300 + item_id % 5 * 100 AS words, CASE WHEN item_id % 3 <> 0 THEN 2000 + item_id % 4 * 500 END AS chars, 2 + CAST(item_id % 2 = 0 AS INT) AS n_keys,
      'key ' || regexp_extract(text, '[A-Za-z]+') AS first_key, 'second key' AS last_key, 2 + item_id % 6 AS last_max, CASE WHEN item_id % 4 = 0 THEN 'alpha,beta' ELSE 'gamma ' || item_id % 10 END AS lsi, 'main ' || item_id % 11 AS main_keyword,
      CASE WHEN item_id % 5 = 0 THEN 'x,y' ELSE 'z' || item_id % 3 END AS additional FROM benchmark""",
    "t13_sentences": f"WITH {_SENT} SELECT doc_id, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words, max(n_words) AS longest FROM sent GROUP BY 1",
    "t15_openers": f"WITH {_SENT}, {_OPEN} SELECT doc_id, 'repetition' AS kind, 'medium' AS severity, 'opener:' || opener AS title, count(*) AS n FROM op GROUP BY doc_id, opener, first HAVING count(*) >= 3 OR (count(*) >= 2 AND first IN ('the', 'la'))",
    "t17_rhythm": f"WITH {_SENT}, p AS (SELECT doc_id, count(*) AS n, stddev_pop(n_words) AS sd, count(*) FILTER (WHERE n_words >= 30) AS l FROM sent GROUP BY 1) SELECT doc_id, 'rhythm' AS kind, 'medium' AS severity, 'even_rhythm' AS title, CAST(1 AS BIGINT) AS n FROM p WHERE n >= 5 AND sd < 4 UNION ALL SELECT doc_id, 'readability', 'medium', 'long_sentences', l FROM p WHERE l > 0",
    "t19_tone": f"SELECT doc_id, 'tone' AS kind, CASE WHEN x < 6 THEN 'medium' ELSE 'high' END AS severity, 'exclamations' AS title, x AS n FROM (SELECT doc_id, length(text) - length(replace(replace(text, '.', ''), '!', '')) AS x FROM ({_DOC}) d) q WHERE x >= 3",
    "t21_dashes": f"SELECT doc_id, 'punctuation' AS kind, CASE WHEN n < 6 THEN 'low' ELSE 'medium' END AS severity, 'dashes' AS title, n FROM (SELECT doc_id, CAST((length(text) - length(replace(text, '. ', ' '))) AS BIGINT) AS n, len(regexp_extract_all(replace(text, '. ', ' — '), '{_W}')) AS w FROM ({_DOC}) d) q WHERE n >= 3 AND 100 * n >= greatest(1, w)",
    "t22_repeated_grams": f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_W}'), lambda x: {_NORMED('x')}) AS w FROM ({_DOC}) d), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) >= 3),
      c AS (SELECT doc_id, array_to_string(g, ' ') AS gram, count(*) AS n FROM g WHERE len(list_filter(g, lambda x: x IN ({", ".join(f"'{x}'" for x in STOP)}))) < 2 GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT doc_id, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM c WHERE gram <> 'of the and') z WHERE r = 1""",
    "t23_paragraphs": f"""SELECT doc_id, 'rhythm' AS kind, 'low' AS severity, 'even_paragraphs' AS title, CAST(1 AS BIGINT) AS n FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: len(regexp_extract_all(x, '{_W}'))) AS k FROM ({_DOC}) d) q WHERE len(k) >= 4 AND list_max(k) - list_min(k) <= 12""",
    "t26_task_facts": f"""WITH t AS ({_TASK}), p AS ({X.sql(X.PROJECTS)}), n AS (SELECT doc_id, max_by(name, (length(name), name)) AS found FROM t JOIN p ON contains(lower(text), lower(name)) GROUP BY 1),
      f AS (SELECT t.doc_id, text, found, nullif(upper(regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}_])([Pp][0-3])(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), '') AS priority, list_distinct(regexp_extract_all(text, 'https?://[^\\s\\])}}>;,]+')) AS u,
        list_distinct(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_:/.-])(/[a-zA-Z0-9_%+~.-]+(?:/[a-zA-Z0-9_%+~.-]+)*/?)', 1)) AS r FROM t LEFT JOIN n ON n.doc_id = t.doc_id),
      g AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?i)сроки?\\s*[:—-]?\\s*([^\n.;]+)', 1), ''), nullif(regexp_extract(text, '(?i)до\\s+(\\d{{1,2}}[./]\\d{{1,2}}(?:[./]\\d{{2,4}})?)', 1), ''), nullif(regexp_extract(text, '(?i)сегодня|завтра|послезавтра'), '')) AS deadline FROM f)
      SELECT doc_id, priority, deadline, array_to_string(list_sort(u), '|') AS urls, array_to_string(list_sort(r), '|') AS relative_urls, {_WORDS_CASE(T.CATEGORIES, 'lower(text)', T.COMMON_CATEGORY)} AS category, found AS project,
        array_to_string(list_filter([CASE WHEN priority IS NULL THEN 'priority' END, CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN len(u) = 0 AND len(r) > 0 THEN 'domain' END, CASE WHEN len(u) = 0 AND len(r) = 0 THEN 'urls' END], lambda x: x IS NOT NULL), ',') AS ambiguities FROM g""",
    "t27_task_lines": _LINES + "SELECT doc_id, pos, section, role, task, kind, CASE WHEN kind = 'task' THEN category END AS category, shown AS line FROM l6",
    "t27_task_groups": _LINES + "SELECT doc_id, role, count(*) FILTER (WHERE kind = 'task') AS tasks, count(*) FILTER (WHERE kind = 'subtask') AS subtasks, min(task) AS first FROM l6 WHERE task IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'task') > 0",
    "t27_checklist": f"SELECT doc_id, unnest(range(len(i))) AS pos, unnest(i) AS item FROM (SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {_HOLDS(w, chr(108) + chr(111) + chr(119))} THEN {chr(39)}{n}{chr(39)} END' for n, w in T.CHECKS)}], lambda x: x IS NOT NULL) AS i FROM (SELECT doc_id, lower(text) AS low FROM ({_TASK}) t) q) z",
    "t28_resolved_urls": f"SELECT doc_id, 'https://e.example/' || CASE WHEN domain IS NOT NULL THEN '|https://' || domain || '/a|https://' || domain || '/b' ELSE '' END AS urls FROM documents d LEFT JOIN ({X.sql(X.PROJECTS)}) p ON p.project_id = d.doc_id % 2000",
}
