"""Parameter studies: synthetic spectra, detection and association over a matrix of arms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions import spectral as sp
from skyvane.operators import association, partitions

# The axes of the study.
SAMPLES, FWHM, CENTRES, BACKGROUNDS = (10_923, 21_846, 43_692, 54_615), (10, 40, 280), (-5300, 3000), ("constant", "exponential")
CONTRASTS, SEPARATIONS, RATIOS = (8, 12, 20), (10, 25, 50, 100, 200, 400), (0, 6, 12)
SIGMAS: tuple[float | None, ...] = (None, 0.0, 5.0, 10.0, 20.0)
REGION = (-5500.0, -5100.0)
SPEC = "samples int, fwhm_hz double, centre_hz double, background string, kind string, contrast_db double, separation_hz double, power_ratio_db double, seed int"


def synthetic_specs(spark: SparkSession, seeds: int = 100) -> DataFrame:
    """Every combination: 3 single and 18 double lines over each base and seed (100,800 with 100 seeds), made on executors."""
    base = [(s, float(f), float(c), b) for s, f, c, b in product(SAMPLES, FWHM, CENTRES, BACKGROUNDS)]
    kinds = [("single", float(c), None, 0.0) for c in CONTRASTS] + [("pair", 26.0, float(d), float(r)) for d, r in product(SEPARATIONS, RATIOS)]
    a = spark.createDataFrame(base, "samples int, fwhm_hz double, centre_hz double, background string")
    b = spark.createDataFrame(kinds, "kind string, contrast_db double, separation_hz double, power_ratio_db double")
    return spark.range(seeds).select(F.col("id").cast("int").alias("seed")).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).select(*[c.split(" ")[0] for c in SPEC.split(", ")])


def recovery(components: list[dict], lines: list[float], width: float) -> dict:
    """Was a line split, found, merged with the other one, and how far off were the detections?"""
    good = [c for c in components if c["eligible"]]
    near = [[i for i, c in enumerate(good) if abs(c["frequency_hz"] - x) <= max(5.0, width / 4)] for x in lines]
    around = sum(c["low_hz"] < lines[0] + width and c["high_hz"] > lines[0] - width for c in good)
    found = bool(near[0]) if len(lines) == 1 else any(i != j for i in near[0] for j in near[1])
    merged = len(lines) == 2 and any(c["low_hz"] <= min(lines) and c["high_hz"] >= max(lines) for c in good)
    off = [min((abs(c["frequency_hz"] - x) for c in good), default=None) for x in lines]
    return {"split": around > 1, "recovered": found, "merged": merged, "detections": len(good), "error_hz": float(np.mean([x for x in off if x is not None])) if any(x is not None for x in off) else None}


def synthetic_results(specs: DataFrame, sigmas: tuple[float | None, ...] = SIGMAS, widths: tuple[float, ...] = (100.0, 200.0, 400.0)) -> DataFrame:
    """specs with a row per representation and width limit: split, recovered, merged, detections, error_hz."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                second = None if pd.isna(r.separation_hz) else r.separation_hz
                f, p = sp.synthetic_spectrum(r.samples, r.fwhm_hz, r.centre_hz, r.background, r.seed, r.contrast_db, second, r.power_ratio_db)
                lines = [r.centre_hz] + ([r.centre_hz + second] if second is not None else [])
                for s in sigmas:
                    found = sp.detect_on(f, p, s)
                    for w in widths:
                        kept = [c | {"eligible": c["eligible"] and c["width_hz"] <= w} for c in found]
                        out.append((*r, "native" if s is None else f"grid_sigma{s:g}", w, *recovery(kept, lines, r.fwhm_hz).values()))
            yield pd.DataFrame(out, columns=[*pdf.columns, "representation", "width_hz", "split", "recovered", "merged", "detections", "error_hz"])

    return specs.mapInPandas(run, f"{SPEC}, representation string, width_hz double, split boolean, recovered boolean, merged boolean, detections bigint, error_hz double")


def cell_rates(results: DataFrame) -> DataFrame:
    """Trials and rates of each cell: a specification without its seed, on one representation and width."""
    keys = [c for c in results.columns if c not in ("seed", "split", "recovered", "merged", "detections", "error_hz")]
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return results.groupBy(*keys).agg(F.count("*").alias("trials"), rate("split"), rate("recovered"), rate("merged"), F.sum("detections").alias("detections"), F.avg("error_hz").alias("mean_error_hz"), F.count_if(F.col("error_hz").isNull()).alias("missing"))


def region_share(f: np.ndarray, p: np.ndarray, components: list[dict]) -> float | None:
    """Share of the power inside the diagnostic region that eligible components hold."""
    total = float(np.diff(sp.cumulative(f, p, np.array(REGION)))[0])
    inside = [(max(c["low_hz"], REGION[0]), min(c["high_hz"], REGION[1])) for c in components if c["eligible"] and c["low_hz"] < REGION[1] and c["high_hz"] > REGION[0]]
    return sum(float(np.diff(sp.cumulative(f, p, np.array(x)))[0]) for x in inside) / total if total else None


def matrix_statuses(spectra: DataFrame, keys: list[str], sigmas: tuple[float | None, ...], widths: tuple[float, ...], margins: tuple[float | None, ...]) -> DataFrame:
    """(representation, width_hz, margin, keys, status) for every arm: detect once per representation, gate each width, associate each.

    spectra: keys, fragment, f array<double>, p array<double>, native power spectra. margin null: connected groups.
    """
    kinds = {x.name: x.dataType.simpleString() for x in spectra.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                f, p = np.asarray(r["f"]), np.asarray(r["p"])
                for s in sigmas:
                    for c in sp.detect_on(f, p, s):
                        out.append((*[r[k] for k in keys], r["fragment"], "native" if s is None else f"grid_sigma{s:g}", f"f{r['fragment']:04d}c{c['component']:04d}", c["frequency_hz"], c["width_hz"], c["eligible"]))
            yield pd.DataFrame(out, columns=[*keys, "fragment", "representation", "candidate_id", "frequency_hz", "width_hz", "eligible"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "fragment"]) + ", representation string, candidate_id string, frequency_hz double, width_hz double, eligible boolean"
    found = spectra.select(*keys, "fragment", "f", "p").mapInPandas(run, schema)
    limits = spectra.sparkSession.createDataFrame([(w,) for w in widths], "limit_hz double")
    reps = spectra.sparkSession.createDataFrame([("native" if s is None else f"grid_sigma{s:g}",) for s in sigmas], "representation string")
    gated = found.crossJoin(F.broadcast(limits)).withColumn("eligible", F.col("eligible") & (F.col("width_hz") <= F.col("limit_hz"))).drop("width_hz")
    frags = spectra.select(*keys, "fragment", F.lit(True).alias("usable")).crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(reps))
    arm = ["representation", "limit_hz", *keys]
    out = None
    for m in margins:
        one = association.track_episodes(gated, frags, arm) if m is None else partitions.associate(gated, frags, arm, m)
        state = F.lit("COMPLETE") if m is None else F.col("state")
        one = one.select("representation", F.col("limit_hz").alias("width_hz"), F.lit(m).cast("double").alias("margin"), *keys, state.alias("state"), "status")
        out = one if out is None else out.unionAll(one)
    return out
