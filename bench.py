"""Headline jobs on one machine: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Each job starts from what its stage of the pipeline reads and is forced to write all of its
rows (to the no-op sink); the median of the warm runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motifmill.operators import bpe as B, decode as D, features as X, tokens as K  # noqa: E402
from motifmill.params import CORPUS, BpeParams  # noqa: E402
from motifmill.plans import jobs as J  # noqa: E402
from motifmill.session import job, local_session, stage  # noqa: E402
from motifmill.sources import projections  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=2 * int(CPUS) if CPUS.isdigit() else 16,
                          **{"spark.driver.memory": "12g"})
    raw = projections.raw_tables(spark, FOLDER)
    raw = type(raw)(*[stage(t, "raw") for t in (raw.pieces, raw.tracks, raw.notes, raw.time_sigs, raw.tempos)])
    tpq = CORPUS.tpq
    tokens = stage(J.build_corpus(raw, CORPUS).tokens, "tokens")
    corpus = stage(K.join_text(tokens), "corpus")
    timed = stage(K.running_time(tokens, tpq), "timed")
    notes = stage(B.to_multi_notes(timed, tpq), "multi_notes")
    shapes = B.learn(notes, tpq, BpeParams(iterations=8)).shapes
    single = B.shapes_frame(spark, B.DEFAULT_SHAPES).select("shape_id", "shape")
    laid_out = B.lay_out(notes).persist()
    laid_out.count()

    def scoring_round():
        keys = B.score_shapes(laid_out, B.DEFAULT_SHAPES, "ours", tpq)
        drain(B.best_shape(B.named_counts(keys.filter("l >= 0"), single)))

    def features():
        pred, hists = J.piece_features(tokens, tpq)
        drain(pred)
        drain(J.evaluate(hists.filter("piece_id % 10 = 3"), hists))

    jobs = {
        "corpus_build": lambda: drain(J.build_corpus(raw, CORPUS).corpus),
        "decode": lambda: drain(J.decode_corpus(corpus, tpq).notes),
        "bpe_scoring_round": scoring_round,
        "bpe_loop_8_rounds": lambda: drain(B.learn(notes, tpq, BpeParams(iterations=8)).multi_notes),
        "bpe_apply_8_shapes": lambda: drain(B.apply_shapes(notes, shapes, tpq)),
        "features_and_comparison": features,
        "token_rows": lambda: drain(J.ExampleBuild(tokens, CORPUS, None).token_rows),
    }
    seconds = {}
    for name, run in jobs.items():
        spent = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            with job(spark):
                run()
            spent.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(spent[1:]), 3)
        print(name, [round(s, 2) for s in spent], file=sys.stderr, flush=True)
    n = raw.notes.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "note_rows": n, "rows_per_sec": {k: round(n / v) for k, v in seconds.items()},
        "master": spark.sparkContext.master, "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
