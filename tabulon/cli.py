"""Command line: python -m tabulon.cli COMMAND …"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from tabulon import api
from tabulon.plans import report, runs
from tabulon.sources.writers import plain, write_json


def _show(rows: list[dict]) -> None:
    for r in rows:
        print(json.dumps(plain(r), ensure_ascii=False))


def _rows(df: DataFrame, most: int = 50) -> list[dict]:
    return [r.asDict() for r in df.limit(most).collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon", description="Understand, clean and model tables on Spark.")
    p.add_argument("--out", default="runs", help="folder of runs")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **more: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, **more)
        for a in args:
            s.add_argument(*a[0], **a[1])
        return s

    data, target, row = (("data",), {}), (("target",), {}), (("--id",), {"default": None})
    columns = ((("--drop",), {"nargs": "*", "default": []}), (("--keep",), {"nargs": "*", "default": []}), (("--sample",), {"type": float}))
    flag = {"action": "store_true"}
    add("profile", data, *columns, (("--target",), {}), help="columns, statistics and issues")
    add("clean", data, *columns, (("output",), {}), (("--target",), {}), (("--outliers",), {"default": "none"}), (("--fill",), {"action": "store_true"}), (("--encode",), {"action": "store_true"}))
    add("train", data, target, row, *columns, (("--also",), {"nargs": "*", "default": [], "help": "further targets"}), (("--models",), {"nargs": "*"}), (("--metric",), {}), (("--folds",), {"type": int, "default": 3}), *[((f"--{f}",), flag) for f in ("thorough", "class-weights", "smote", "log-target", "threshold", "combine")])
    add("tune", data, target, (("model",), {}), row, *columns, (("--metric",), {}), (("--trials",), {"type": int, "default": 10}), (("--folds",), {"type": int, "default": 3}))
    add("predict", (("model",), {}), data, (("output",), {}))
    add("evaluate", (("model",), {}), data, target)
    add("explain", (("model",), {}), data, row)
    add("drift", (("reference",), {}), (("new",), {}))
    add("importance", data, target, *columns, (("--methods",), {"nargs": "*"}))
    add("select", data, target, (("--top",), {"type": int, "default": 5}), (("--methods",), {"nargs": "*"}))
    add("cluster", data, (("output",), {}), row, (("--groups",), {"default": "auto"}))
    add("anomaly", data, (("output",), {}), row, (("--contamination",), {"default": "0.05"}))
    add("forecast", data, (("date",), {}), (("value",), {}), (("output",), {}), (("--group",), {"nargs": "*", "default": []}), (("--unit",), {}), (("--horizon",), {"type": int, "default": 14}), (("--inputs",), {"nargs": "*", "default": []}), (("--plans",), {"help": "a table of planned inputs"}), (("--holidays",), {"nargs": "*", "default": []}), (("--combine",), {"default": "sum"}), (("--save",), {"help": "keep the forecaster as JSON"}), (("--use",), {"help": "go on with a kept forecaster"}), (("--only",), {"nargs": "*", "help": "groups to forecast"}))
    add("report", (("run",), {"nargs": "?", "default": "latest"}))
    add("runs", (("--prune",), {"type": int}))
    add("compare", (("names",), {"nargs": "*"}))
    add("models")
    add("init", (("path",), {"nargs": "?", "default": "tabulon.json"}))
    add("run", (("config",), {}))
    add("serve", (("model",), {"nargs": "?"}), (("--port",), {"type": int, "default": 8000}), (("--host",), {"default": "127.0.0.1"}), (("--key",), {}), (("--forecaster",), {}), (("--history",), {}))
    add("deploy", (("model",), {}), (("folder",), {}), (("--port",), {"type": int, "default": 8000}))
    add("sample", (("name",), {"nargs": "?"}), (("output",), {"nargs": "?"}), (("--rows",), {"type": int}))
    add("look", data)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "models":
        from tabulon.operators.train import ABSENT, SPECS

        _show([{"model": s.key, "tasks": list(s.tasks), "tier": s.tier, "rows": s.cap, "note": s.note} for s in SPECS.values()] + [{"model": k, "note": v} for k, v in ABSENT.items()])
        return 0
    if a.command == "runs":
        if a.prune is not None:
            print("\n".join(runs.prune(a.out, a.prune)))
        else:
            _show(runs.listed(a.out))
        return 0
    if a.command == "compare":
        found = runs.listed(a.out)
        chosen = [r for r in found if r["name"] in a.names] if a.names else found[:5]
        _show(report.compare_runs(chosen))
        return 0
    if a.command == "report":
        folder = runs.resolve(a.out, a.run)
        about = json.loads((folder / "run.json").read_text())
        (folder / "report.html").write_text(report.report({"name": folder.name, **about}))
        print(folder / "report.html")
        return 0
    if a.command == "init":
        write_json({"data": "data.csv", "target": "y", "quick": True, "out": "runs"}, a.path)
        return 0
    if a.command == "deploy":
        from tabulon.plans.serve import deploy

        print(deploy(a.folder, runs.model_path(a.out, a.model), a.port))
        return 0
    spark = api.session()
    if a.command == "sample":
        from tabulon.sources import samples

        if a.name and a.output:
            api.save(samples.sample_table(spark, a.name, a.rows), a.output)
        else:
            _show([{"table": k, "for": v} for k, v in samples.names().items()])
        return 0
    if a.command == "run":
        c = runs.load_config(a.config)
        return main(["--out", c.get("out", a.out), "train", c["data"], c["target"], *(["--models", *c["models"]] if c.get("models") else [])])
    if a.command == "serve":
        from tabulon.plans.serve import serve

        kept = api.load_forecaster(a.forecaster) if a.forecaster else None
        serve(spark, api.load_model(str(runs.model_path(a.out, a.model))) if a.model else None, a.port, a.key, kept, api.load(spark, a.history) if a.history else None, a.host)
        return 0
    if a.command == "drift":
        table, verdict = api.compare_drift(api.load(spark, a.reference), api.load(spark, a.new))
        _show(_rows(table))
        print(verdict)
        return 0
    df = api.load(spark, a.data, sample=getattr(a, "sample", None))
    if getattr(a, "drop", None) or getattr(a, "keep", None):
        own = [c for c in (getattr(a, "target", None), getattr(a, "id", None), *getattr(a, "also", ())) if c]
        df = api.chosen(df, a.drop, [*a.keep, *[c for c in own if c not in a.keep]] if a.keep else [])
    if a.command == "look":
        _show([report.summarised(df)])
        return 0
    if getattr(a, "id", "") is None:
        from pyspark.sql import functions as F

        a.id = "row_id_"
        df = df.withColumn(a.id, F.monotonically_increasing_id())
    if a.command == "profile":
        stats, found = api.profile(df, a.target)
        _show(_rows(api.kinds(df), 1000) + _rows(stats, 1000) + _rows(found, 1000))
    elif a.command == "clean":
        api.save(api.clean(df, a.target, a.outliers, a.fill, a.encode).data, a.output)
    elif a.command == "train":
        folder = runs.create(a.out, f"train {a.target}")
        options = {"models": a.models, "quick": not a.thorough, "metric": a.metric, "k": a.folds, "class_weights": a.class_weights, "smote": a.smote, "log_target": a.log_target, "threshold": a.threshold, "combine": a.combine}
        from tabulon.operators.train import CLASSIFICATION, save

        if a.also:
            many = api.train_many(df, [a.target, *a.also], a.id, **options)
            save(many, str(folder / "model"))
            runs.save(folder, {"command": "train", "target": [a.target, *a.also], "task": many.task, "model": {t: m.key for t, m in many.models.items()}, "rows": df.count(), "metrics": many.evaluate(df), "fingerprint": api.fingerprint(df)})
            print(folder)
            return 0
        fitted = api.train(df, a.target, a.id, **options)
        save(fitted, str(folder / "model"))
        inputs = sorted({c for _, c in fitted.encoding.columns()})
        about = {"command": "train", "target": a.target, "task": fitted.task, "model": fitted.key, "metric": fitted.metric, "classes": fitted.classes, "threshold": fitted.threshold, "rows": df.count(), "inputs": inputs, "leaderboard": fitted.leaderboard, "skipped": fitted.skipped, "metrics": api.evaluate(fitted, df, a.target), "fingerprint": api.fingerprint(df), "kinds": _rows(api.kinds(df), 1000), "issues": _rows(api.profile(df, a.target)[1], 1000)}
        about["importance"] = [{"column": c, "score": v} for c, v in api.sensitivity(fitted, df, a.id).items()]
        if fitted.task == CLASSIFICATION:
            from tabulon.functions.metrics import confusion

            about["confusion"] = _rows(confusion(fitted.predict(df.dropna(subset=[a.target])), a.target, "predicted"), 10_000)
        runs.save(folder, about)
        Path(folder, "card.md").write_text(report.card(about))
        _show(fitted.leaderboard)
        print(folder)
    elif a.command == "predict":
        model = api.load_model(str(runs.model_path(a.out, a.model)))
        warned = model.warning(df) if hasattr(model, "warning") else None
        if warned:
            print(warned, file=sys.stderr)
        api.save(api.predict(model, df), a.output)
    elif a.command == "evaluate":
        _show([api.evaluate(api.load_model(str(runs.model_path(a.out, a.model))), df, a.target)])
    elif a.command == "explain":
        print("\n".join(api.explain_text(api.load_model(str(runs.model_path(a.out, a.model))), df, a.id)))
    elif a.command == "tune":
        _show(api.tune(df, a.target, a.id, a.model, a.metric, a.trials, a.folds))
    elif a.command == "importance":
        _show(_rows(api.importance(df, a.target, a.methods).orderBy("consensus_rank")))
    elif a.command == "select":
        print("\n".join(api.select(df, a.target, a.top, a.methods)))
    elif a.command == "cluster":
        from tabulon.functions.values import parse_range

        api.save(api.groups(df, a.id, parse_range(a.groups)), a.output)
    elif a.command == "anomaly":
        from tabulon.functions.values import parse_share

        api.save(api.anomalies(df, a.id, parse_share(a.contamination) or 0.05), a.output)
    elif a.command == "forecast":
        plans = api.load(spark, a.plans) if a.plans else None
        if a.use:
            kept = api.load_forecaster(a.use)
            api.save(kept.forecast(df, plans, a.only, a.horizon), a.output)
        elif a.save:
            kept = api.fit_forecast(df, a.date, a.value, group=a.group, unit=a.unit, horizon=a.horizon, combine=a.combine, inputs=a.inputs, holiday_dates=a.holidays)
            api.save_forecaster(kept, a.save)
            _show(kept.leaderboard)
            api.save(kept.forecast(df, plans, a.only), a.output)
        else:
            api.save(api.forecast(df, a.date, a.value, a.group, a.unit, a.horizon, a.combine, a.inputs, plans, a.holidays), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
