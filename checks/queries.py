"""The registered queries: each runs an operator over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawsieve import catalogue as cat
from flawsieve.functions.context import context_score
from flawsieve.functions.prompts import parse_answer
from flawsieve.functions.scoring import (PIPELINE_CONFIDENCE, severity_level,
                                         should_escalate)
from flawsieve.functions.vectors import array_cosine, mean_vectors
from flawsieve.operators import findings as tables
from flawsieve.operators import embedding_store as store
from flawsieve.operators import report, training
from flawsieve.operators.analysis import attach_analyses, route_analysis, standard_analysis
from flawsieve.operators.classify import classify_findings, with_alternatives
from flawsieve.operators.linewise import (detector_eligible, file_lines, keyword_scan,
                                          merge_detector, pattern_lane_eligible)
from flawsieve.operators.matching import scan_matches
from flawsieve.operators.nearest import similar_among_many
from flawsieve.operators.prompts import collapse_prompts, render_prompts, with_window
from flawsieve.operators.scoring import score_findings, scored_terms
from flawsieve.operators.similarity import hashed_ngrams, similar_patterns
from flawsieve.operators.training import known_patterns, learning_cycle, training_rows
from flawsieve.plans.detect import detect
from flawsieve.plans.requests import answer_requests
from flawsieve.plans.scan import escalations, scan, scan_lines
from flawsieve.plans.scan import merged_findings as findings_of
from flawsieve.sources.files import (changed_files, decoded_files, list_directory, read_listed,
                                     skipped, source_files)
from flawsieve.sources.staging import staged, staging_folder
from flawsieve.streaming.incremental import current_findings, incremental_scan

from .corpus import corpus, path_of, table

EDITED_CATALOGUE = cat.remove_rule(
    cat.add_rule(cat.DEFAULT_CATALOGUE, {
        "id": "X001", "name": "Assignment", "pattern": r"^\w+\s*=\s*\w+\.\w+\(",
        "finding_type": "Call", "severity": "Low"}), "R001")[0]

# Rules that Java's regexes can't express: a group that is asked for if another one took part.
CONDITIONAL_CATALOGUE = (
    cat.with_needles(cat.Rule("F001", r'(secret = )?"(?(1)s\d+|k\d+)', "Named Secret", "High",
                              needs_escalation=True), '"k', '"s'),
    *cat.DETERMINISTIC_RULES,
    cat.with_needles(cat.Rule("keyed_call", r"(\.)?(?(1)load|exec)\(", "Call", "Low",
                              lane=cat.HEURISTIC), "load(", "exec("),
    *cat.HEURISTIC_RULES)

REPORT_COLUMNS = ("file", "line", "seq", "finding_type", "severity", "evidence", "risk_score",
                  "needs_escalation", "sources")


def _source_corpus(spark, sf_dir) -> DataFrame:
    return source_files(corpus(spark, sf_dir))


def _sources(findings: DataFrame) -> DataFrame:
    """Sources as one text, to be comparable everywhere."""
    return findings.withColumn("sources", F.array_join(
        F.transform("source_details", lambda s: F.concat(s.lane, F.lit(":"), s.pattern)), ","))


def rule_scan(spark, sf_dir):
    return scan_matches(corpus(spark, sf_dir), cat.DETERMINISTIC_RULES).select(
        "file", "ord", "k", F.col("pattern").alias("rule_id"), "finding_type", "severity",
        "evidence", "line", "needs_escalation")


def heuristic_scan(spark, sf_dir):
    return scan_matches(corpus(spark, sf_dir), cat.HEURISTIC_RULES).select(
        "file", "ord", "k", "pattern", "finding_type", "severity", "evidence", "line",
        "confidence")


def custom_rule_scan(spark, sf_dir):
    rules = tuple(r for r in EDITED_CATALOGUE if r.lane == cat.RULE)
    return scan_matches(corpus(spark, sf_dir), rules).select(
        "file", "k", F.col("pattern").alias("rule_id"), "finding_type", "evidence", "line")


def fallback_rule_scan(spark, sf_dir):
    """Rules for two regex engines in one scan, merged by line."""
    return _sources(scan(corpus(spark, sf_dir), CONDITIONAL_CATALOGUE)).select(*REPORT_COLUMNS)


def fallback_matches(spark, sf_dir):
    """The single matches of the same catalogue."""
    return scan_matches(corpus(spark, sf_dir), CONDITIONAL_CATALOGUE).select(
        "file", "ord", "k", "lane", "pattern", "evidence", "line", "needs_escalation")


def web_page_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id")
    return scan_matches(pages, path="url", content="html").groupBy("file", "pattern").agg(
        F.count("*").alias("matches"), F.min("line").alias("first_line"))


def document_scan(spark, sf_dir):
    """Scan of the documents as they are; few of them hold anything."""
    documents = table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return _sources(scan(documents)).select(*REPORT_COLUMNS)


def path_filter(spark, sf_dir):
    return _source_corpus(spark, sf_dir).select(
        "path", "extension", F.octet_length("content").alias("bytes"))


def _tree(spark, sf_dir) -> str:
    """The corpus written as a tree of files with a wide and a deep branch; its root."""
    root = staging_folder(spark)
    key = F.col("doc_id")
    path = F.when(key % 3 == 0, F.concat(F.lit("wide/mod_"), key, F.lit(".py"))).otherwise(
        F.concat(F.lit("deep/"), F.repeat(F.lit("d/"), ((key / 3).cast("int") % 12)),
                 F.when(key % 30 == 1, "node_modules/").otherwise(""), F.lit("mod_"), key,
                 F.when(key % 3 == 1, ".js").otherwise(".txt")))
    files = corpus(spark, sf_dir).select(path.alias("path"), "content")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if ":/" in root \
            else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                full = f"{base}/{path.as_py()}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(full) as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"files": [len(batch)]})

    files.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


def directory_scan(spark, sf_dir):
    root = _tree(spark, sf_dir)
    files = read_listed(list_directory(spark, root, budget=100), root)
    return _sources(scan(files)).select(*REPORT_COLUMNS)


def directory_entries(spark, sf_dir):
    return skipped(list_directory(spark, _tree(spark, sf_dir), budget=50))


def lenient_decode(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit("a\r\nb\rc").cast("binary"), F.unhex(F.lit("ff")),
        F.col("text").cast("binary"), F.unhex(F.lit("c328"))).alias("data"))
    return decoded_files(raw).select("doc_id", F.md5("content").alias("digest"),
                                     F.length("content").alias("chars"))


def eligible_lines(spark, sf_dir):
    lines = file_lines(corpus(spark, sf_dir))
    return lines.groupBy("file").agg(
        F.count("*").alias("lines"),
        F.count_if(pattern_lane_eligible(F.col("text"))).alias("pattern_lane"),
        F.count_if(detector_eligible(F.col("text"))).alias("detector"))


def _raw_with_confidence(spark, sf_dir):
    """All heuristic matches, with confidences that differ from match to match."""
    raw = scan_matches(corpus(spark, sf_dir), cat.HEURISTIC_RULES)
    return raw.withColumn("seq", F.col("ord").cast("long") * 10**9 + F.col("k")).withColumn(
        "confidence", F.lit(0.5) + F.pmod(F.col("k") * 7 + F.col("ord") * 3, F.lit(10)) / 20)


def heuristic_dedup(spark, sf_dir):
    return tables.dedup(staged(_raw_with_confidence(spark, sf_dir))).select(
        "file", "line", "finding_type", "pattern", "severity", "evidence",
        F.round("confidence", 6).alias("confidence"))


def detector_merge(spark, sf_dir):
    raw = _raw_with_confidence(spark, sf_dir).select(
        "file", "line", "finding_type", "severity", "evidence", "seq", "confidence")
    return merge_detector(raw).withColumn("confidence", F.round("confidence", 6))


def table_merge(spark, sf_dir):
    raw = staged(scan_matches(corpus(spark, sf_dir)).withColumn(
        "seq", F.col("ord").cast("long") * 10**9 + F.col("k")))
    kept = raw.where("lane = 'rule'").unionByName(
        tables.dedup(raw.where("lane = 'heuristic'")), allowMissingColumns=True)
    merged = tables.merge(kept)
    scores = raw.select("file", "line", "seq",
                        (F.length("evidence") / 100.0).alias("score"))
    return _sources(tables.attach_scores(merged, scores)).select(*REPORT_COLUMNS)


def risk_scores(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return scan_lines(files).select("file", "line", "line_score",
                                    F.element_at("findings", -1).finding_type
                                    .alias("scored_type"))


def score_rows(spark, sf_dir):
    """The stand-alone scorer on each match and its file's text."""
    files = corpus(spark, sf_dir).withColumn("terms", scored_terms(F.col("content")))
    findings = scan_matches(files, keep=("terms",)).select(
        "file", "ord", "k", "finding_type", "severity", "evidence", "line", "terms")
    return score_findings(findings, "terms", fallback_model=True)


def escalation(spark, sf_dir):
    return escalations(scan_lines(_source_corpus(spark, sf_dir))).select(
        "file", "line", "k", "finding_type", "pattern", "needs_escalation", "line_score")


def escalation_lookup(spark, sf_dir):
    """Findings joined with the last score of their line, 0.5 where there is none."""
    raw = staged(scan_matches(corpus(spark, sf_dir)).withColumn(
        "seq", F.col("ord").cast("long") * 10**9 + F.col("k")))
    scores = raw.where("lane = 'rule'").select(
        "file", "line", "seq", (F.length("evidence") / 50.0).alias("score"))
    joined = tables.line_scores_or_default(
        raw.select("file", "line", "seq", "pattern", "needs_escalation"), scores)
    return joined.withColumn("escalate", should_escalate(
        F.col("line_score"), F.lit(PIPELINE_CONFIDENCE), F.col("needs_escalation")))


def merged_findings(spark, sf_dir):
    return _sources(scan(corpus(spark, sf_dir))).select(*REPORT_COLUMNS)


def scan_report(spark, sf_dir):
    findings = scan(_source_corpus(spark, sf_dir), analyse=True)
    return report.report_order(_sources(findings)).select(
        *REPORT_COLUMNS, "explanation", "fix_suggestion")


def ordered_report(spark, sf_dir):
    """The whole report in one order."""
    return report.ranked_report(_sources(scan(_source_corpus(spark, sf_dir))).select(
        *REPORT_COLUMNS))


def filtered_report(spark, sf_dir):
    findings = scan(_source_corpus(spark, sf_dir), strict=True, analyse=True)
    return _sources(findings).select(*REPORT_COLUMNS, "explanation")


def code_report(spark, sf_dir):
    findings = scan(_source_corpus(spark, sf_dir), context_filter=True, analyse=True)
    return _sources(findings).select(*REPORT_COLUMNS, "explanation")


def report_summary(spark, sf_dir):
    files = _source_corpus(spark, sf_dir)
    return report.summary(scan(files), files)


def gate(spark, sf_dir):
    return report.gate(report_summary(spark, sf_dir)).select("exit_code")


def top_findings(spark, sf_dir):
    return report.top_findings(scan(_source_corpus(spark, sf_dir), analyse=True))


def json_report(spark, sf_dir):
    return report.json_rows(scan(corpus(spark, sf_dir)))


def context_validate(spark, sf_dir):
    raw = scan_matches(corpus(spark, sf_dir))
    return raw.select(
        "file", "ord", "k", "finding_type",
        context_score(F.col("finding_type"), F.col("evidence")).alias("c")).select(
        "file", "ord", "k", "finding_type", "c.is_vulnerable",
        F.round("c.confidence", 9).alias("confidence"),
        F.array_join("c.reasons", "; ").alias("reasons"))


def classified_findings(spark, sf_dir):
    c = classify_findings(scan(corpus(spark, sf_dir)).select(
        "file", "line", "finding_type", "severity"))
    return c.select("file", "line", "finding_type", "severity", "confidence",
                    severity_level(F.col("severity")).alias("level"),
                    "classification.risk", "classification.description",
                    F.array_join("classification.examples", "|").alias("examples"),
                    "classification.fix")


def safe_alternatives(spark, sf_dir):
    return with_alternatives(scan(corpus(spark, sf_dir)).select(
        "file", "line", "finding_type")).select(
        "file", "line", "finding_type",
        F.array_join("safe_alternatives", "|").alias("safe_alternatives"))


def keyword_lines(spark, sf_dir):
    return keyword_scan(file_lines(corpus(spark, sf_dir)))


def _label_patterns(spark, sf_dir) -> DataFrame:
    """One pattern per label: the mean of its vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return mean_vectors(vectors, "label", "embedding").select(
        F.col("label").cast("int").alias("ord"), F.col("mean").alias("vector"))


def cosine_threshold(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select("vec_id",
                                                      F.col("embedding").alias("vector"))
    return similar_patterns(items, _label_patterns(spark, sf_dir), ["vec_id"],
                            threshold=0.2).withColumn(
        "similarity", F.round("similarity", 6))


def cosine_best(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select("vec_id",
                                                      F.col("embedding").alias("vector"))
    return similar_patterns(items, _label_patterns(spark, sf_dir), ["vec_id"],
                            threshold=0.0, best_only=True).withColumn(
        "similarity", F.round("similarity", 6))


def cosine_blocks(spark, sf_dir):
    """The vectors whose id is divisible by 100 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    items = vectors.where("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("vector"))
    patterns = vectors.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return similar_among_many(items, patterns, ["vec_id"], threshold=0.25, blocks=32,
                              patterns_a_task=4096, items_a_task=1024).withColumn(
        "similarity", F.round("similarity", 6))


def cosine_nearest(spark, sf_dir):
    """For the same ids the best of all vectors for the sum of their and the next one's vector."""
    vectors = table(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"),
                               F.col("embedding").alias("other"))
    items = vectors.where("vec_id % 100 = 0").join(following, "vec_id").select(
        "vec_id", F.zip_with("embedding", "other", lambda a, b: a.cast("double") + 2 * b)
        .alias("vector"))
    patterns = vectors.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return similar_among_many(items, patterns, ["vec_id"], threshold=0.0, best_only=True,
                              blocks=32).withColumn("similarity", F.round("similarity", 6))


def cosine_to_label(spark, sf_dir):
    """Similarity of each vector to the mean of its own label, in plain expressions."""
    vectors = table(spark, sf_dir, "embeddings")
    means = mean_vectors(vectors, "label", "embedding")
    return vectors.join(means, "label").select(
        "vec_id", "label",
        F.round(array_cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


def mean_pool(spark, sf_dir):
    """Masked mean per label; the mask leaves out vectors whose first component is not
    positive."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    pooled = mean_vectors(vectors, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("mean").alias("dim", "v")).select(
        "label", "dim", F.round("v", 6).alias("value"))


def detector_scan(spark, sf_dir):
    return detect(corpus(spark, sf_dir), hashed_ngrams()).withColumn(
        "confidence", F.round("confidence", 6))


def semantic_report(spark, sf_dir):
    findings = scan(corpus(spark, sf_dir), embed=hashed_ngrams())
    return _sources(findings).select(*REPORT_COLUMNS)


def embedding_store(spark, sf_dir):
    """The similarity lane by stored vectors: half of the files fill the store, then all are
    scanned, and what was still missing is added before."""
    path, files = staging_folder(spark), corpus(spark, sf_dir)
    store.add_vectors(store.eligible_texts(files.where("doc_id % 2 = 0")), path,
                        hashed_ngrams(), "half")
    store.add_vectors(store.eligible_texts(files), path, hashed_ngrams(), "all")
    return _sources(scan(files, embed=hashed_ngrams(), store=path)).select(*REPORT_COLUMNS)


def _escalated_windows(spark, sf_dir):
    return escalations(scan_lines(_source_corpus(spark, sf_dir), window=True))


def prompt_window(spark, sf_dir):
    return _escalated_windows(spark, sf_dir).select("file", "line", "k", "window")


def prompt_window_join(spark, sf_dir):
    """The same window for findings that come as a table."""
    files = corpus(spark, sf_dir)
    found = staged(escalations(scan_lines(files)).select("file", "line", "k"))
    return with_window(found, files).select(
        "file", "line", "k", F.md5("window").alias("digest"))


def prompt_render(spark, sf_dir):
    return render_prompts(_escalated_windows(spark, sf_dir)).select(
        "file", "line", "k", "key", F.md5("document").alias("digest"))


def prompt_export(spark, sf_dir):
    return collapse_prompts(render_prompts(_escalated_windows(spark, sf_dir))).select(
        "key", "finding_type", "file", "line", F.md5("document").alias("digest"))


def stub_analysis(spark, sf_dir):
    a = standard_analysis(F.col("finding_type"))
    return scan_matches(corpus(spark, sf_dir)).groupBy("file", "finding_type").agg(
        F.count("*").alias("matches")).select(
        "*", a.explanation.alias("explanation"), a.fix_suggestion.alias("fix_suggestion"))


def response_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", parse_answer(F.col("text")).alias("a")).select(
        "conv_id", "turn", "a.explanation", "a.fix_suggestion")


def _answers(spark, sf_dir):
    """Answers to some escalated lines: the last assistant turn of the conversation that has the
    id of the document, with a line that speaks of a fix."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy(
        "conv_id").agg(F.max_by("text", "turn").alias("text"))
    return turns.select(path_of(F.col("conv_id")).alias("file"),
                        F.concat("text", F.lit("\nFix: "), "text").alias("answer"))


def analysis_routing(spark, sf_dir):
    found = escalations(scan_lines(_source_corpus(spark, sf_dir))).select(
        "file", "line", "k", "finding_type")
    return route_analysis(found, _answers(spark, sf_dir), ["file"])


def analysed_report(spark, sf_dir):
    lines = staged(scan_lines(_source_corpus(spark, sf_dir)))
    routed = route_analysis(
        escalations(lines).select("file", "line", "k", "finding_type"),
        _answers(spark, sf_dir), ["file"])
    findings = findings_of(lines).select("file", "line", "seq", "finding_type", "severity")
    return attach_analyses(findings, routed, order="k")


def training_set(spark, sf_dir):
    findings = scan(corpus(spark, sf_dir), keep=("content",))
    return training_rows(findings).select(
        "file", "line", "seq", "finding_type", "severity", "evidence",
        F.md5("code").alias("code_digest"), "label")


def training_roundtrip(spark, sf_dir):
    """The examples of two scans, put into a set, one of them twice, and read again."""
    path = staging_folder(spark)
    rows = staged(training_rows(scan(corpus(spark, sf_dir), keep=("content", "lang"))
                                .filter("lang in ('en', 'fr')").withColumn(
        "content", F.concat("lang", F.lit(":"), F.md5("content")))))
    for scan_id in ("en", "fr", "en"):
        training.save_examples(rows.filter(F.startswith("code", F.lit(scan_id))), path, scan_id)
    return training.load_examples(spark, path).groupBy(
        "scan_id", "finding_type", "severity", "evidence", "code").agg(
        F.count("*").alias("copies"), F.sum("label").alias("labels"))


def known_pattern_summary(spark, sf_dir):
    findings = scan(corpus(spark, sf_dir), keep=("content",))
    return known_patterns(staged(training_rows(findings).drop("code")), ["file", "line", "seq"])


def findings_history(spark, sf_dir):
    """Each language is one scan; the history counts its findings."""
    scans = scan(corpus(spark, sf_dir), keep=("lang",)).withColumnRenamed("lang", "scan_id")
    return training.findings_history(scans)


def learning_rounds(spark, sf_dir):
    findings = staged(scan(corpus(spark, sf_dir), keep=("content",)).select(
        "file", "line", "seq", "finding_type", "severity", "evidence",
        F.md5("content").alias("content")))
    history, examples = learning_cycle(findings, 3)
    learned = examples.groupBy("iteration").agg(F.count("*").alias("examples"),
                                                F.sum("label").alias("label_sum"))
    return history.join(learned, "iteration", "left")


def changed_file_scan(spark, sf_dir):
    """Scan of the files that diffs name; each document's diff names its successor's file."""
    diffs = table(spark, sf_dir, "documents").select(F.concat(
        F.lit("diff --git a/"), path_of(F.col("doc_id") + 1), F.lit(" b/"),
        path_of(F.col("doc_id") + 1), F.lit("\n--- a/x b/y\n+diff --git\n")).alias("diff"))
    files = changed_files(corpus(spark, sf_dir), diffs)
    return _sources(scan(files)).select(*REPORT_COLUMNS)


def incremental_findings(spark, sf_dir):
    """Versions of files in two micro-batches: the second one changes a third of the files, and
    repeats another third; the findings are those of the last versions."""
    folder = staging_folder(spark)
    files = corpus(spark, sf_dir)
    first = files.select("path", "content", F.lit(1).cast("long").alias("version"))
    second = files.where("doc_id % 3 < 2").select("path", F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("eval(new)\n"), "content")).otherwise(
        F.col("content")).alias("content"), F.lit(2).cast("long").alias("version"))
    stream = spark.readStream.schema(first.schema).parquet(f"{folder}/arriving/*")
    for number, rows in enumerate((first, second)):
        rows.write.parquet(f"{folder}/arriving/{number}")
        query = incremental_scan(stream, f"{folder}/out", checkpoint=f"{folder}/state",
                                 name=f"incremental_{os.path.basename(folder)}_{number}",
                                 available_now=True)
        query.awaitTermination()
    return _sources(current_findings(spark, f"{folder}/out")).select(*REPORT_COLUMNS)


def request_batch(spark, sf_dir):
    """One request per document, of each kind in turn."""
    documents = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    kind = F.pmod(key, F.lit(7))
    code = F.concat("text", F.lit("\neval(x)\nDEBUG = True"))
    params = F.struct(
        F.when(kind == 1, F.concat(F.lit("a/b/"), path_of(key)))
        .when(kind == 2, path_of(key)).when(kind == 3, F.concat(path_of(key), F.lit(".gone")))
        .alias("file_path"),
        F.when(kind == 1, code).when(kind == 2, "").alias("file_content"),
        F.when(kind == 0, code).alias("code"),
        F.when((kind == 0) & (F.pmod(key, F.lit(2)) == 0), F.lit("x.py")).alias("filename"),
        F.when(kind == 4, F.get(F.lit(["src", "./web/", "src/app", ".", "none", "docs"]),
                                F.pmod(key, F.lit(6)))).alias("repo_path"))
    method = (F.when(kind == 0, "analyze_code").when(kind <= 3, "analyze_file")
              .when(kind == 4, "analyze_repository").otherwise("explain"))
    requests = documents.select(
        key.alias("request_id"),
        F.when(kind == 6, "not json").otherwise(
            F.to_json(F.struct(method.alias("method"), params.alias("params"))))
        .alias("request"))
    return answer_requests(requests, corpus(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    rule_scan, heuristic_scan, custom_rule_scan, fallback_rule_scan, fallback_matches,
    web_page_scan, document_scan, path_filter,
    directory_scan, directory_entries, lenient_decode, eligible_lines, heuristic_dedup, detector_merge, table_merge, risk_scores,
    score_rows, escalation, escalation_lookup, merged_findings, scan_report, ordered_report,
    filtered_report,
    code_report, report_summary, gate, top_findings, json_report, context_validate,
    classified_findings, safe_alternatives, keyword_lines, cosine_threshold, cosine_best,
    cosine_blocks, cosine_nearest,
    cosine_to_label, mean_pool, detector_scan, semantic_report, embedding_store,
    prompt_window,
    prompt_window_join, prompt_render, prompt_export, stub_analysis, response_parse,
    analysis_routing, analysed_report, training_set, training_roundtrip, known_pattern_summary, findings_history,
    learning_rounds, changed_file_scan, incremental_findings, request_batch,
)}
