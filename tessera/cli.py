"""Commands over tables: ``python -m tessera.cli COMMAND --table t.parquet ...``; expected errors end with status 2."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, coerce
from tessera.operators import ablation, association, diagnostics, folds, linear, metrics, models, nested, pooling
from tessera.sources import audio, recordings, sinks, tables


def _read(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def _config(args: argparse.Namespace) -> Config:
    config = Config.from_yaml(Path(args.config).read_text(encoding="utf-8")) if args.config else Config()
    for item in args.set or ():
        key, _, value = item.partition("=")
        section, _, name = key.partition(".")
        config = config.override({section: {name: coerce(value)}})
    return config if args.seed is None else config.override({"data": {"seed": args.seed}})


def _columns(args: argparse.Namespace) -> list[str] | None:
    return [c.strip() for c in (args.columns or "").split(",") if c.strip()] or None


def _analysis(args: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, list[str]]:
    return tables.analysis_table(_read(spark, args.table), args.target, _columns(args))


def _front_end(config: Config) -> audio.FrontEnd:
    f = config.frontend
    if f.preset:
        if f.preset not in audio.PRESETS:
            raise ValueError(f"frontend.preset must be one of {', '.join(audio.PRESETS)}, got {f.preset!r}")
        return audio.PRESETS[f.preset]
    return audio.FrontEnd(f.frame_ms, f.hop_ms, f.mels, f.coefficients, f.low, f.high, f.emphasis, f.lifter, f.window, f.energy, f.floor)


def _task_table(args: argparse.Namespace, config: Config, spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """The table of a model with its fold column: whole groups where a group column is set, classes balanced."""
    if config.data.task == "regression":
        d, x = _analysis(args, spark)
        if not config.data.group:
            return folds.shuffled(d, config.data.folds, [*x, args.target], config.data.seed), x
    d = _read(spark, args.table)
    x = _columns(args) or [c for c, kind in d.dtypes if kind in ("double", "float", "int", "bigint") and c not in (args.target, config.data.group)]
    d = d.dropna(subset=[*x, args.target])
    if config.data.group:
        f = folds.grouped(d, config.data.folds, config.data.group, config.data.seed).select(F.col(config.data.group).alias("_group"), "fold")
        return d.join(f, F.col(config.data.group) == F.col("_group")).drop("_group"), x
    return folds.stratified(d, config.data.folds, args.target, x, config.data.seed), x


def _positive(config: Config):
    return coerce(config.data.positive) if config.data.positive else None


def pool(args, config, spark):
    p = config.pooling
    out = pooling.pool(_read(spark, args.table), args.key.split(","), _columns(args), p.statistics, p.percentiles, p.normalization)
    sinks.save_features(out, args.out, config.to_dict())
    return {"rows": out.count()}


def extract(args, config, spark):
    """Frame features of every recording below a folder, and the status of each file: a table, or files in a mirrored tree."""
    if args.format != "parquet":
        c = config.frontend
        table = recordings.extract_tree(spark, args.table, args.out, _front_end(config), c.delta_order, args.format, c.trim)
        return {r.status: r["count"] for r in table.groupBy("status").count().collect()}
    found = audio.read_wav(spark, args.table)
    f = _front_end(config)
    audio.export_frames(audio.frame_features(found.where("error IS NULL"), f, config.frontend.delta_order), audio.frame_columns(f, config.frontend.delta_order), f"{args.out}/frames", args.format)
    status = audio.extraction_status(found, f)
    sinks.write_csv(status.orderBy("path"), f"{args.out}/status")
    return {r.status: r["count"] for r in status.groupBy("status").count().collect()}


def features(args, config, spark):
    """A row of pooled features per recording below a folder."""
    f, p = _front_end(config), config.pooling
    out = audio.utterance_features(audio.read_wav(spark, args.table).where("error IS NULL"), f, config.frontend.delta_order, p.statistics, p.percentiles, p.normalization)
    sinks.save_features(out, args.out, config.to_dict())
    return {"rows": out.count()}


def match(args, config, spark):
    """Ids of a table matched to the recordings below a folder (``--model``)."""
    ids = _read(spark, args.table).select(F.col(args.key or "id").cast("string").alias("id"))
    files = audio.list_audio(spark, args.model).select("path")
    out = tables.match_ids(ids, files).persist()
    sinks.write_csv(out, args.out)
    found = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    unused = tables.check_matches(out, files).count()
    out.unpersist()
    return found | {"unused": unused}


def correlate(args, config, spark):
    d, x = _analysis(args, spark)
    sinks.write_csv(association.feature_correlations(d, x, args.target, config.analysis.confidence, config.analysis.correction), args.out)
    return {"features": len(x)}


def regress(args, config, spark):
    d, x = _analysis(args, spark)
    fit = linear.fit_ols(d, x, args.target, config.analysis.confidence)
    lm, p = diagnostics.breusch_pagan(d, fit, args.target)
    sinks.write_csv(fit.coefficients(spark), args.out)
    return {"stats": fit.stats, "breusch_pagan": lm, "breusch_pagan_p": p}


def diagnose(args, config, spark):
    """Residual report in the table's own row order (or by ``--order``), influence of every row, and collinearity."""
    order = [c for c in (args.order or "").split(",") if c]
    raw = _read(spark, args.table)
    d, x = tables.analysis_table(raw if order else tables.with_place(raw), args.target, _columns(args), order or tables.PLACE)
    d = tables.with_row_number(d, order or tables.PLACE).select("row", *order, args.target, *x).persist()
    fit = linear.fit_ols(d, x, args.target, config.analysis.confidence)
    sinks.write_csv(diagnostics.influence_table(d, fit, args.target, ["row", *order]), args.out)
    report = diagnostics.residual_report(d, fit, args.target, ["row"]).first().asDict()
    inflation = {t: v for t, _, v in diagnostics.variance_inflation(linear.moments(d, x, args.target))} if len(x) > 1 else {}
    d.unpersist()
    return {"residuals": report, "vif": inflation, "condition_number": diagnostics.condition_number(fit)}


def stepwise(args, config, spark):
    d, x = _analysis(args, spark)
    a = config.analysis
    chosen, steps = linear.stepwise(linear.moments(d, x, args.target), a.p_enter, a.p_remove, a.stepwise_start)
    return {"selected": chosen, "steps": steps}


def order_sweep(args, config, spark):
    d, x = _analysis(args, spark)
    sweep = linear.order_sweep(d, x[0], args.target, config.analysis.degrees)
    return {"degrees": sweep, "recommended": linear.recommended(sweep)}


def descend(args, config, spark):
    d, x = _analysis(args, spark)
    found = linear.gradient_descent(linear.moments(d, x, args.target))
    return {"status": found.status, "iterations": len(found.costs) - 1, "coefficients": dict(zip(found.terms, found.beta.tolist(), strict=True))}


def evaluate(args, config, spark):
    d, x = _task_table(args, config, spark)
    task, m = config.data.task, config.model
    positive = _positive(config)
    fixed, other = config.model_settings(), {"reducer": m.reducer, "seed": config.data.seed}
    chosen = []
    if m.tune:
        p, chosen = nested.cross_validate(d, x, args.target, m.name, task, inner=m.inner, group=config.data.group or None, fixed=fixed, **other)
    else:
        p = models.cross_validate(d, x, args.target, m.name, task, fixed, **other)
    out = models.evaluated(p, args.target, task, "fold", positive, None if positive is None else f"score_{positive}").persist()
    sinks.write_csv(out.orderBy("fold"), args.out)
    found = out.where("fold IS NULL").first().asDict()
    out.unpersist()
    return found | ({"tuned": [{k: c[k] for k in ("fold", "settings", "score")} for c in chosen]} if chosen else {})


def train(args, config, spark):
    d, x = _task_table(args, config, spark)
    m, task, tried = config.model, config.data.task, []
    if m.tune:
        model, tried = models.tune(d, x, args.target, m.name, task, reducer=m.reducer, seed=config.data.seed)
    else:
        model = models.fit(d, x, args.target, m.name, task, config.model_settings(), m.reducer, seed=config.data.seed)
    model.save(args.out, spark)
    return {"model": m.name, "settings": model.settings, "tried": tried}


def predict(args, config, spark):
    out = models.load(args.model, spark).predict(_read(spark, args.table))
    out.write.mode("overwrite").parquet(args.out)
    return {"rows": out.count()}


def ablate(args, config, spark):
    """Settings over the same repeats and folds, compared with the first of them.

    The axes come from the configuration (``ablation.axes``) or are the models of ``--models``. With ``--recordings`` the table
    is an index of recordings by path, and the axes may change their front end; frames are kept in a store beside the results.
    """
    axes = dict(config.ablation.axes) or {"model": [n.strip() for n in (args.models or "linear,ridge").split(",")]}
    task = config.data.task
    if wrong := ablation.problems(axes, task, normalization=config.pooling.normalization, n_ceps=config.frontend.coefficients, n_mels=config.frontend.mels):
        raise ValueError(" | ".join(wrong))
    names, seed = [f"fold_r{r}" for r in range(config.data.repeats)], config.data.seed
    if args.recordings:
        ids = tables.load_index(_read(spark, args.table), args.target, task)
        d = folds.repeated(ids, config.data.folds, config.data.repeats, ["path"], seed, "group" if folds.has_groups(ids, "group") else None)
        p = config.pooling
        features = ablation.recording_features(spark, args.recordings, d, f"{args.out}/frames", _front_end(config), config.frontend.delta_order, p.statistics, p.normalization)
    else:
        if set(axes) - {"model", "reducer"}:
            raise ValueError("axes of the front end need --recordings")
        d, x = _task_table(args, config, spark)
        d = folds.repeated(d.drop("fold"), config.data.folds, config.data.repeats, [*x, args.target], seed, config.data.group or None, args.target if task == "classification" else None)
        features = lambda point: (d, x)
    points = ablation.expand_grid(axes)
    metric = metrics.HEADLINE[task]
    positive = _positive(config)
    table = ablation.run(points, features, args.target, names, task, positive, None if positive is None else f"score_{positive}", config.model.tune, config.model.inner)
    sinks.write_csv(ablation.summarize(table, metric, lower_is_better=task == "regression"), f"{args.out}/summary")
    sinks.write_csv(table, f"{args.out}/folds")
    sinks.write_csv(ablation.compare_to_baseline(table, metric, points[0]["config_id"], task == "regression", config.analysis.correction), f"{args.out}/comparison")
    return {"settings": len(points), "folds": config.data.folds * config.data.repeats}


def synthesize(args, config, spark):
    """A table of made-up measurements (``--table`` names it: surface, polynomial or collinear)."""
    makers = {"surface": tables.quadratic_surface_table, "polynomial": tables.polynomial_table, "collinear": tables.collinear_table}
    if args.table not in makers:
        raise ValueError(f"the table must be one of {', '.join(makers)}, got {args.table!r}")
    out = makers[args.table](spark, seed=config.data.seed)
    out.write.mode("overwrite").parquet(args.out)
    return {"rows": out.count()}


COMMANDS = {f.__name__.replace("_", "-"): f for f in (synthesize, pool, extract, features, match, correlate, regress, diagnose, stepwise, order_sweep, descend, evaluate, train, predict, ablate)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--table", required=True, help="a Parquet or CSV table, or a folder of recordings")
    parser.add_argument("--target")
    parser.add_argument("--key", default="")
    parser.add_argument("--columns")
    parser.add_argument("--order", help="columns, separated by commas, that order the rows; by default their order in the files")
    parser.add_argument("--config", help="a YAML file")
    parser.add_argument("--set", action="append", metavar="SECTION.NAME=VALUE")
    parser.add_argument("--seed", type=int)
    parser.add_argument("--model", help="a saved model; of match: the folder of recordings")
    parser.add_argument("--recordings", help="of ablate: the folder of recordings that the table is an index of")
    parser.add_argument("--models", help="models to compare, the baseline first")
    parser.add_argument("--format", default="parquet", choices=("parquet", "text", "htk"))
    parser.add_argument("--out", default="out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        result = COMMANDS[args.command](args, _config(args), spark)
    except (ValueError, ImportError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(sinks.to_json(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
