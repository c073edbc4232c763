"""Texts against briefs, editorial style, and task texts."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.functions import grams as G
from sitescope.functions.words import WORD, normal, normal_word, stem
from sitescope.sources.tables import settled, small

# The editorial rules' default word lists.
CONNECTORS = ("также", "при этом", "кроме того", "поэтому", "таким образом")
GENERIC_OPENERS = ("также", "кроме", "при", "для", "это", "такая", "такой", "данный", "данная", "компания", "специалисты", "поставщики")
GRAM_STOP = ("и", "в", "на", "с", "для", "по", "из", "а", "к", "что", "как", "или", "при", "это", "также")
MARKERS = (
    ("в современном мире", "cliche", "high"), ("не секрет, что", "cliche", "high"), ("важно отметить", "cliche", "high"), ("следует отметить", "cliche", "medium"),
    ("подводя итоги", "cliche", "high"), ("таким образом", "template", "medium"), ("на сегодняшний день", "officialese", "medium"), ("для удобства", "template", "medium"),
    ("это помогает", "template", "medium"), ("позволяет", "abstract", "low"), ("обеспечивает", "abstract", "low"), ("осуществляется", "officialese", "medium"),
    ("производится", "officialese", "medium"), ("используются", "passive", "low"), ("является", "linking", "low"),
)
COMMON = ("abstract", "linking", "passive")
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
PARTICIPLE = r"(?iU)\b[А-Яа-яЁё-]{4,}(?:(?:ющ|ащ|ящ|вш)(?:ий|ая|ее|ие|его|ему|им|ими|их)|(?:ем|им)(?:ый|ая|ое|ые|ого|ому|ым|ыми|ых))\b"
GERUND = r"(?iU)\b[А-Яа-яЁё-]{4,}(?:вши|вшись|ившись|ывшись|учи|ючи)\b"
#: A sentence with its end; line breaks do not end it.
SENTENCE = r"[^.!?…]+(?:[.!?…]+|$)"
COST = {"high": 11, "medium": 7, "low": 3}
#: Fixed values of task texts: roles, categories (the first that fits), and checks, by the words that stand for them.
ROLES = (
    ("Разработчик", ("разработчик", "front-end", "back-end", "frontend", "backend")),
    ("Контент-менеджер", ("контент-менеджер", "контент менеджер")),
    ("SEO-специалист", ("seo-специалист", "seo специалист", "сео-специалист")),
    ("Дизайнер", ("дизайнер",)),
)
CATEGORIES = (
    ("Перелинковка", ("перелинков", "внутренн", "ссыл", "анкор", "донор")),
    ("Техническое SEO", ("robots", "x-robots", "sitemap", "canonical", "breadcrumb", "хлебн", "schema.org", "индексац", "gsc", "краулинг")),
    ("Контент", ("текст", "тизер", "анонс", "контент", "стать", "описан", "главн", "хаб")),
    ("Изображения", ("изображ", "фото", "картин", "alt", "webp", "avif", "баннер")),
    ("Разработка", ("верст", "dom", "меню", "мега-меню", "код", "frontend", "backend", "cms", "301", "404")),
)
CHECKS = (
    ("desktop", ("",)), ("mobile", ("",)), ("links", ("ссыл", "перелинков", "донор", "анкор")), ("content", ("текст", "контент", "тизер", "анонс", "стать", "описан")),
    ("breadcrumbs", ("breadcrumb", "хлебн", "breadcrumblist")), ("robots", ("robots",)), ("x-robots", ("x-robots",)), ("sitemap", ("sitemap",)),
    ("canonical", ("canonical", "каноникал")), ("redirects", ("301", "редирект")),
)
ACTIONS = (
    "добав созда подготов размест замен исправ провер настро убер удал сдел перенес обнов доработ встав загруз опублик простав переимен сверст реализ напис "
    "сгенер перелинк оптимиз скоррект вывести подключ убед"
).split()
TITLES = ("тз ", "тз№", "тз №", "техническое задание")
COMMON_ROLE, COMMON_CATEGORY = "Общее", "Общее"
RELATIVE_URL = r"(?<![\w:/.-])(/[a-zA-Z0-9а-яА-ЯёЁ_%+~.-]+(?:/[a-zA-Z0-9а-яА-ЯёЁ_%+~.-]+)*/?)(?=[\s\]),.;:!?]|$)"
DEADLINE = (
    r"(?iU)(?:срок(?:и)?\s*[:—-]?\s*([^\n.;]+)|до\s+(\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?)|(?:сегодня|завтра|послезавтра)|(?:недел(?:я|и|ю|ь)\s*\d+(?:\s*[–—-]\s*\d+)?))"
)


def words(text) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(f"({WORD})"), F.lit(1))


def snippet(text: Column, start: Column, end: Column, radius: int = 70) -> Column:
    left = F.greatest(F.lit(0), start - radius)
    right = F.least(F.length(text), end + radius)
    inner = F.trim(F.regexp_replace(F.substr(text, left + 1, right - left), r"(?U)\s+", " "))
    return F.concat(F.when(left > 0, "…").otherwise(""), inner, F.when(right < F.length(text), "…").otherwise(""))


def parse_briefs(briefs: DataFrame, text: str = "text") -> DataFrame:
    """Briefs as structs: address, targets, keyword rows, and the lists of related, additional and competing items."""
    t = F.col(text)
    grab = lambda p: F.trim(F.regexp_extract(t, p, 1))
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda y: F.trim(F.regexp_replace(F.trim(y), r"^[-*• ]+", ""))), lambda y: y != "")
    keys = F.filter(lines(grab(r"(?isU)Добавьте\s+в\s+текст\s+ключевые\s+слова\**\s*(.*?)(?=Добавьте\s+в\s+текст\s+LSI|$)")), lambda y: y.rlike(r"(?iU).+?:\s*\d+\s*-\s*\d+"))
    row = lambda y: F.struct(F.trim(F.regexp_extract(y, r"(?i)^(.+?):\s*\d+\s*-", 1)).alias("phrase"), F.regexp_extract(y, r":\s*(\d+)\s*-\s*\d+", 1).cast("int").alias("min"), F.regexp_extract(y, r":\s*\d+\s*-\s*(\d+)", 1).cast("int").alias("max"), F.when(y.rlike("(?iU)найдено"), F.regexp_extract(y, r"(?iU)найдено\s*:\s*(\d+)", 1).cast("int")).alias("found_in_source"))
    size = r"(?iU)Рекомендуемое\s+количество\s+слов:\*{0,2}\s*(\d+)\s*слов(?:\s*\((\d+)\s*символов\))?"
    number = lambda k: F.when(F.regexp_extract(t, size, k) != "", F.regexp_extract(t, size, k).cast("int"))
    return briefs.select(
        "brief_id", F.regexp_extract(t, r"(https?://[^\s)\]]+)", 1).alias("url"), number(1).alias("words"), number(2).alias("chars"), F.transform(keys, row).alias("keywords"),
        lines(grab(r"(?isU)Добавьте\s+в\s+текст\s+LSI\**\s*(.*?)(?=Структура\s+статьи|Главное\s+ключевое|$)")).alias("lsi"),
        F.btrim(grab(r"(?iU)Главное\s+ключевое\s+слово:\**\s*([^\n]+)"), F.lit("* ")).alias("main_keyword"),
        lines(grab(r"(?isU)Дополнительные\s+ключевые\s+слова:\**\s*(.*)$")).alias("additional"),
        F.regexp_extract_all(grab(r"(?isU)Конкуренты\**\s*(.*?)(?=Пример\s+Н1|$)"), F.lit(r"(https?://[^\s)\]]+)"), F.lit(1)).alias("competitors"),
    )


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a sentence with words: (doc_id, pos, sentence, n_words)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SENTENCE})"), F.lit(1))
    rows = docs.select("doc_id", F.posexplode(raw).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim(F.regexp_replace("s", r"(?U)\s+", " ")).alias("sentence"))
    return rows.withColumn("n_words", F.size(words("sentence")).cast("long")).where("n_words > 0")


def _finding(kind: str, severity: Column | str, title, count) -> list[Column]:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    name = F.lit(title) if isinstance(title, str) else title
    return [F.col("doc_id"), F.lit(kind).alias("kind"), sev.alias("severity"), name.alias("title"), count.cast("long").alias("n")]


def marker_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings from a rule table (marker, title, severity): small, so every document meets every rule."""
    n = F.expr("regexp_count(low, concat('(?iU)\\\\b', marker, '\\\\b'))")
    hit = docs.select("doc_id", normal("text").alias("low")).join(small(rules)).withColumn("n", n).where((F.col("n") > 0) & (~F.col("title").isin(*COMMON) | (F.col("n") >= 2)))
    up = F.when((F.col("n") >= 3) & (F.col("severity") == "low"), "medium").when((F.col("n") >= 3) & (F.col("severity") == "medium"), "high").otherwise(F.col("severity"))
    return hit.select(*_finding("marker", up, F.concat("title", F.lit(":"), "marker"), F.col("n")))


def repeated_openers(sents: DataFrame, generic=GENERIC_OPENERS) -> DataFrame:
    two = F.transform(F.slice(words("sentence"), 1, 2), lambda w: normal(w))
    rows = sents.select("doc_id", F.array_join(two, " ").alias("opener"), F.get(two, F.lit(0)).alias("first"))
    often = rows.groupBy("doc_id", "opener", "first").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) | ((F.col("n") >= 2) & F.col("first").isin(*generic)))
    return often.select(*_finding("repetition", "medium", F.concat(F.lit("opener:"), "opener"), F.col("n")))


def alike(a: set[str], b: set[str]) -> float:
    """How much two sentences say the same: by shared stems, of both or of the shorter one; short ones say too little."""
    if min(len(a), len(b)) < 3:
        return 0.0
    same = len(a & b)
    return max(same / len(a | b), 0.86 * same / min(len(a), len(b)))


def neighbour_similarity(docs: DataFrame, stop: tuple[str, ...] = (), least: float = 0.56, text: str = "text") -> DataFrame:
    """(doc_id, pos, score): sentences whose next one says much the same. Within the row: words are stemmed once a worker."""
    stopped, stems = frozenset(stop), {}

    def content(sentence: str) -> set[str]:
        out = set()
        for w in map(normal_word, re.findall(WORD, sentence)):
            if len(w) > 2 and w not in stopped and not re.fullmatch("[0-9]+", w):
                if w not in stems:
                    if len(stems) > 500_000:
                        stems.clear()
                    stems[w] = stem(w)
                if len(stems[w]) >= 3:
                    out.add(stems[w])
        return out

    def run(batches):
        for batch in batches:
            owner, pos, score = [], [], []
            for k, t in enumerate(batch.column(text)):
                before = None
                for at, s in enumerate(re.findall(SENTENCE, t.as_py() or "")):
                    if not re.search(WORD, s):
                        continue
                    own = content(s)
                    if before is not None and (value := alike(before[1], own)) >= least - 0.0001:
                        owner.append(k)
                        pos.append(before[0])
                        score.append(value)
                    before = at, own
            kept = batch.column("doc_id").take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(pos, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "pos", "score"])

    found = docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos long, score double")
    return found.select("doc_id", "pos", F.round("score", 4).alias("score")).where(F.col("score") >= least)


def rhythm(sents: DataFrame) -> DataFrame:
    per = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("n_words").alias("sd"), F.count_if(F.col("n_words") >= 30).alias("long"))
    even = per.where((F.col("n") >= 5) & (F.col("sd") < 4)).select(*_finding("rhythm", "medium", "even_rhythm", F.lit(1)))
    return even.unionByName(per.where("long > 0").select(*_finding("readability", "medium", "long_sentences", F.col("long"))))


def connectors(docs: DataFrame, rules: tuple[str, ...] = CONNECTORS) -> DataFrame:
    low = normal("text")
    each = F.array(*(F.struct(F.lit(w).alias("w"), F.regexp_count(low, F.lit(rf"(?iU)\b{w}\b")).alias("n")) for w in rules))
    return docs.select("doc_id", F.explode(each).alias("c")).where("c.n >= 3").select(*_finding("repetition", "medium", F.concat(F.lit("connector:"), F.col("c.w")), F.col("c.n")))


def tone(docs: DataFrame) -> DataFrame:
    e, x = F.regexp_count("text", F.lit(EMOJI)), F.regexp_count("text", F.lit("!"))
    rows = docs.select("doc_id", e.alias("e"), x.alias("x"))
    emoji = rows.where("e > 0").select(*_finding("tone", F.when(F.col("e") >= 3, "high").otherwise("medium"), "emoji", F.col("e")))
    return emoji.unionByName(rows.where("x >= 3").select(*_finding("tone", F.when(F.col("x") < 6, "medium").otherwise("high"), "exclamations", F.col("x"))))


def verb_forms(docs: DataFrame, patterns: tuple[str, ...] = (PARTICIPLE, GERUND)) -> DataFrame:
    rows = docs.select("doc_id", sum((F.regexp_count("text", F.lit(p)) for p in patterns), F.lit(0)).alias("n")).where("n >= 3")
    return rows.select(*_finding("syntax", F.when(F.col("n") < 6, "medium").otherwise("high"), "verb_forms", F.col("n")))


def dashes(docs: DataFrame, dash: str = "—") -> DataFrame:
    rows = docs.select("doc_id", F.regexp_count("text", F.lit(dash)).alias("n"), F.greatest(F.lit(1), F.size(words("text"))).alias("w")).where((F.col("n") >= 3) & (100 * F.col("n") >= F.col("w")))
    return rows.select(*_finding("punctuation", F.when(F.col("n") < 6, "low").otherwise("medium"), "dashes", F.col("n")))


def repeated_gram(docs: DataFrame, protected: tuple[str, ...] = (), stop: tuple[str, ...] = GRAM_STOP) -> DataFrame:
    """The most repeated three words of each document; of equally many the first by text. All within the row: no shuffle."""
    stopped, kept_out = frozenset(stop), frozenset(protected)

    def most(text: str | None) -> tuple[str | None, int]:
        w = [normal_word(x) for x in re.findall(WORD, text or "")]
        weak = [x in stopped for x in w]
        seen = Counter(g for g, k in zip(zip(w, w[1:], w[2:]), range(len(w))) if weak[k] + weak[k + 1] + weak[k + 2] < 2)
        often = ((-n, " ".join(g)) for g, n in seen.items() if n >= 2)
        best = min((x for x in often if x[1] not in kept_out), default=(0, None))
        return best[1], -best[0]

    found = F.pandas_udf(lambda t: pd.DataFrame([most(x) for x in t], columns=["gram", "n"]), "struct<gram:string,n:long>")
    return docs.select("doc_id", found("text").alias("g")).where("g.gram is not null").select("doc_id", "g.gram", "g.n")


def paragraph_regularity(docs: DataFrame, raw: bool = True) -> DataFrame:
    """Four paragraphs or more of almost one length. On a text without blank lines there is but one paragraph."""
    source = F.col("text") if raw else F.regexp_replace("text", r"\n\s*\n+", "\n")
    parts = F.filter(F.split(source, r"\n\s*\n+"), lambda x: F.trim(x) != "")
    n = F.transform(parts, lambda x: F.size(words(x)))
    rows = docs.select("doc_id", F.size(parts).alias("k"), (F.array_max(n) - F.array_min(n)).alias("spread")).where("k >= 4 and spread <= 12")
    return rows.select(*_finding("rhythm", "low", "even_paragraphs", F.lit(1)))


def style_result(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Score, counts by severity, and the first eight findings to rewrite."""
    once = findings.dropDuplicates(["doc_id", "title", "n"])
    cost = F.when(F.col("severity") == "high", COST["high"]).when(F.col("severity") == "medium", COST["medium"]).otherwise(COST["low"])
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    per = once.groupBy("doc_id").agg(F.sum(cost).alias("cost"), *(F.count_if(F.col("severity") == s).alias(s) for s in COST), F.array_sort(F.collect_list(F.when(F.col("severity") != "low", F.struct(rank.alias("r"), "title")))).alias("first"))
    out = docs.select("doc_id").join(per, "doc_id", "left").na.fill(0, ["cost", *COST])
    first = F.array_join(F.transform(F.slice(F.coalesce("first", F.array().cast("array<struct<r:int,title:string>>")), 1, 8), lambda x: x["title"]), "|")
    return out.select("doc_id", F.greatest(F.lit(0), 100 - F.col("cost")).cast("long").alias("score"), *COST, first.alias("rewrite_first"))


def names_in(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name): the longest of the names that a text contains, in any case; of equally long ones the last by letters.

    Every name is filed under the run of its letters that the fewest texts hold. Texts send the places of such runs, with as
    many characters around as the longest name has; the name itself is compared there. So what is shuffled grows with the
    hits of rare runs, not with the texts.
    """
    known = names.select(F.lower("name").alias("low"), "name").where("low <> ''").distinct()
    offered = known.select("low", F.explode(G.runs_of(F.col("low"))).alias("run"))
    texts = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    seen = G.places(texts, "doc_id", "low", G.carried(offered))
    counts = seen.join(small(offered.select("run").distinct()), "run").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    filed = settled(G.rarest(offered, counts, "low"))
    longest = known.agg(F.max(F.length("low"))).first()[0] or 0
    found = G.places(texts, "doc_id", "low", G.carried(filed), longest).join(small(filed), "run")
    offset = F.instr("low", F.col("run")) - 1
    there = F.concat(F.right("before", offset), F.substr("after", F.lit(1), F.length("low") - offset)) == F.col("low")
    held = found.where(there).select("doc_id", "low").distinct().join(small(known), "low")
    return held.groupBy("doc_id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))


def _holds(low: Column, words) -> Column:
    """Whether a lower-cased text holds one of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def _first_of(low: Column, table, otherwise: str | None) -> Column:
    return F.coalesce(*(F.when(_holds(low, words), name) for name, words in table), F.lit(otherwise))


def tidy_line(text) -> Column:
    return F.btrim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\s+", " "), F.lit(" \t•*-—;,.\n"))


def task_category(text) -> Column:
    return _first_of(F.lower(text), CATEGORIES, COMMON_CATEGORY)


def task_facts(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """Priority, deadline, addresses, category and project of a task's text, and what it leaves open.

    The project is the longest name that the text contains, else what follows a word like "project:".
    """
    t = F.col("text")
    urls = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)(https?://[^\s\])}>;,]+)"), F.lit(1)))
    relative = F.array_distinct(F.regexp_extract_all(t, F.lit(RELATIVE_URL), F.lit(1)))
    priority = F.upper(F.regexp_extract(t, r"(?iU)\b(P[0-3])\b", 1))
    said = [tidy_line(F.regexp_extract(t, DEADLINE, k)) for k in (1, 2, 0)]
    due = F.coalesce(*(F.when(x != "", x) for x in said))
    named = F.substring(tidy_line(F.regexp_extract(t, r"(?iU)(?:проект|сайт|клиент)\s*[:—-]\s*([^\n.;]+)", 1)), 1, 80)
    project = names_in(docs, projects).withColumnRenamed("name", "found")
    rows = docs.select("doc_id", F.when(priority != "", priority).alias("priority"), due.alias("deadline"), urls.alias("u"), relative.alias("r"), task_category(t).alias("category"), F.when(named != "", named).alias("named"))
    open_points = F.array(
        F.when(F.col("priority").isNull(), "priority"), F.when(F.col("deadline").isNull(), "deadline"),
        F.when((F.size("u") == 0) & (F.size("r") > 0), "domain"), F.when((F.size("u") == 0) & (F.size("r") == 0), "urls"),
    )
    return rows.join(project, "doc_id", "left").select(
        "doc_id", "priority", "deadline", F.array_join("u", "|").alias("urls"), F.array_join("r", "|").alias("relative_urls"), "category",
        F.coalesce("found", "named").alias("project"), F.array_join(F.array_compact(open_points), ",").alias("ambiguities"),
    )


def task_lines(docs: DataFrame) -> DataFrame:
    """The lines of a task's text with what they are: (doc_id, pos, section, role, task, kind, category, line).

    The first line that names the paper is its title; it is no note, wherever it stands again.
    Headings of goals, results and roles set the section and the role of the lines below; a numbered line, or one with a
    colon at its end among tasks, opens a task, to which problem, solution, subtasks and notes belong until the next heading.
    Sections and roles are carried forward by windows over each document's lines.
    """
    c, last = F.col, lambda x, w: F.last(x, ignorenulls=True).over(w)
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    numbered = c("raw").rlike(r"^\d+[.)]\s*.+$")
    lines = raw.select("doc_id", c("pos").cast("long").alias("pos"), numbered.alias("numbered"), tidy_line(F.when(numbered, F.regexp_replace("raw", r"^\d+[.)]\s*", "")).otherwise(c("raw"))).alias("line"))
    low = F.lower("line")
    lines = lines.where("line <> ''").withColumn("led", _first_of(low, ROLES, None))
    heading = (
        F.when(low.startswith("цели тз") | low.startswith("цель тз"), "goals").when(low.startswith("ожидаемый результат"), "expected")
        .when(c("led").isNotNull() & (low.startswith("задач") | F.contains(low, F.lit("для "))), "tasks")
    )
    upto = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("heading", heading).withColumn("section", F.coalesce(last(heading, upto), F.lit("context")))
    lines = lines.withColumn("role", F.coalesce(last(F.when(c("heading") == "tasks", c("led")), upto), F.lit(COMMON_ROLE)))
    lines = lines.withColumn("part", F.count("heading").over(upto)).withColumn("reference", c("heading").isNull() & low.rlike(r"[.](xlsx|xls|pdf|docx)$"))
    free = c("heading").isNull() & ~c("reference") & c("section").isin("context", "tasks")
    within = Window.partitionBy("doc_id", "part").orderBy("pos")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    among_tasks = (c("section") == "tasks") | F.coalesce(F.max(free & c("numbered")).over(before), F.lit(False))
    labelled = low.startswith("проблема:") | low.startswith("решение:") | low.startswith("пример:")
    opens = free & (c("numbered") | (among_tasks & c("line").endswith(":") & ~labelled))
    lines = lines.withColumn("opens", opens.cast("int")).withColumn("inside", F.max("opens").over(within) == 1)
    action = F.exists(F.array(*map(F.lit, ACTIONS)), lambda a: F.startswith(F.split_part(low, F.lit(" "), F.lit(1)), a))
    kind = (
        F.when(c("heading").isNotNull(), "heading").when(c("reference"), "reference").when(c("section") == "goals", "goal").when(c("section") == "expected", "result")
        .when(c("opens") == 1, "task").when(~c("inside"), "note").when(low.startswith("проблема:"), "problem").when(low.startswith("решение:"), "solution")
        .when(low.startswith("пример:"), "note").when(action, "subtask").otherwise("note")
    )
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.first(F.when(F.exists(F.array(*map(F.lit, TITLES)), lambda t: F.startswith(low, t)), c("line")), ignorenulls=True).over(whole)
    lines = lines.withColumn("title", title)
    kind = F.when((kind == "note") & ~c("inside") & (c("line") == c("title")), "title").otherwise(kind)
    number = F.sum("opens").over(upto)
    lines = lines.withColumn("kind", kind).withColumn("task", F.when(c("inside") & c("kind").isin("task", "problem", "solution", "subtask", "note"), number))
    after = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    shown = F.when(c("kind").isin("problem", "solution") | ((c("kind") == "heading") & (c("heading") == "expected")), after).when(c("kind") == "task", F.rtrim("line", F.lit(":"))).otherwise(c("line"))
    return lines.select("doc_id", "pos", "section", "role", "task", "kind", F.when(c("kind") == "task", task_category("line")).alias("category"), shown.alias("line"))


def task_groups(lines: DataFrame) -> DataFrame:
    """(doc_id, role, tasks, subtasks, first): the tasks of each role, in order of the role's first task."""
    own = lines.where("task is not null")
    per = own.groupBy("doc_id", "role").agg(F.count_if(F.col("kind") == "task").alias("tasks"), F.count_if(F.col("kind") == "subtask").alias("subtasks"), F.min("task").alias("first"))
    return per.where("tasks > 0")


def checklist(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, item): what to check when the task is done, by the words of its text."""
    low = F.lower("text")
    items = F.array_compact(F.array(*(F.when(_holds(low, words), name) for name, words in CHECKS)))
    return docs.select("doc_id", F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


def resolve_urls(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """A task's addresses: absolute ones first, relative ones on the project's domain, each once."""
    both = tasks.join(projects.select("project_id", "domain"), "project_id", "left")
    made = F.transform("relative", lambda r: F.concat(F.lit("https://"), F.col("domain"), r))
    return both.select("doc_id", F.array_join(F.array_distinct(F.concat("absolute", F.when(F.col("domain").isNotNull(), made).otherwise(F.array().cast("array<string>")))), "|").alias("urls"))
