"""Reports from small results: histograms, HTML, model cards and run comparisons."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.writers import plain


def bins_for(n: int, most: int = 40) -> int:
    return max(5, min(most, int(math.sqrt(n))))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of bins of equal width from the least to the largest value; the last one is closed."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if row["lo"] is None:
        return df.limit(0).select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"))
    width = float(row["hi"] - row["lo"]) or 1.0
    at = F.least(F.floor((F.col(column) - row["lo"]) / width * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def html_table(rows: list[dict], title: str = "") -> str:
    """A small result as an HTML table."""
    if not rows:
        return f"<h2>{html.escape(title)}</h2><p>none</p>"
    names = list(rows[0])
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[n])}</td>" for n in names) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def page(title: str, parts: list[str]) -> str:
    style = "body{font:15px sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def bars(rows: list[dict], label: str, value: str, title: str = "") -> str:
    """A small result as bars in HTML."""
    most = max((abs(r[value] or 0) for r in rows), default=0) or 1
    line = lambda r: f"<tr><td>{html.escape(str(r[label]))}</td><td style='width:30em'><div style='background:#4a78b5;height:1em;width:{100 * abs(r[value] or 0) / most:.1f}%'></div></td><td>{r[value]:.4g}</td></tr>" if r[value] is not None else ""
    return f"<h2>{html.escape(title)}</h2><table>{''.join(map(line, rows))}</table>"


def report(about: dict) -> str:
    """A run as a page: what was asked, the columns, the models, the importances and the errors, as far as the run holds them."""
    small = {k: v for k, v in about.items() if isinstance(v, (str, int, float, bool)) or v is None}
    parts = [html_table([{"key": k, "value": str(v)} for k, v in small.items()], "Run")]
    for key, title in (("kinds", "Columns"), ("statistics", "Numbers"), ("issues", "Issues"), ("leaderboard", "Models"), ("drift", "Drift")):
        if about.get(key):
            parts.append(html_table(about[key], title))
    board = [r for r in about.get("leaderboard") or [] if r.get("score") is not None]
    if board:
        parts.append(bars(board, "model", "score", "Scores"))
    if about.get("importance"):
        parts.append(bars(about["importance"], "column", "score", "Importance"))
    if about.get("confusion"):
        parts.append(html_table(confusion_grid(about["confusion"]), "Answers by class, as shares of each class"))
    if about.get("metrics"):
        parts.append(html_table([{"metric": k, "value": v} for k, v in about["metrics"].items()], "On the training rows"))
    if about.get("skipped"):
        parts.append(html_table([{"model": k, "reason": v} for k, v in about["skipped"].items()], "Not tried"))
    return page(str(about.get("name") or about.get("command") or "Run"), parts)


def confusion_grid(rows: list[dict]) -> list[dict]:
    """confusion()'s rows as a row for each true class, with the share of each answer."""
    answers = sorted({str(r["predicted"]) for r in rows})
    part = {(str(r["actual"]), str(r["predicted"])): r["row_share"] for r in rows}
    return [{"class": a, **{f"answered {p}": part.get((a, p), 0.0) for p in answers}} for a in sorted({str(r["actual"]) for r in rows})]


def card(about: dict) -> str:
    """A model card in Markdown: what it predicts, from what, how well, and which models were tried."""
    lines = [f"# {about['target']}", "", f"Task: {about['task']}. Model: {about['model']}. Rows: {about['rows']}.", "", "## Inputs", ""]
    lines += [f"- {c}" for c in about["inputs"]]
    if about.get("kinds"):
        lines += ["", "## Data", "", "| column | kind | missing | distinct |", "|-|-|-|-|"]
        lines += [f"| {r['column']} | {r['kind']} | {r['n_missing']} | {r['n_unique']} |" for r in about["kinds"]]
        lines += ["", *[f"- {r['level']}: {r['code']}{' in ' + r['column'] if r['column'] else ''}" for r in about.get("issues") or []]]
    if about.get("classes"):
        lines += ["", f"Classes: {', '.join(map(str, about['classes']))}." + (f" Answers the second from a probability of {about['threshold']:.3g} on." if about.get("threshold") is not None else "")]
    lines += ["", "## Scores", "", f"Cross-validated {about.get('metric') or 'score'}.", "", "| model | score | std |", "|-|-|-|"]
    lines += [f"| {r['model']} | {r['score'] if r['score'] is None else round(r['score'], 4)} | {r['std'] if r['std'] is None else round(r['std'], 4)} |" for r in about["leaderboard"]]
    if about.get("skipped"):
        lines += ["", "Not tried: " + "; ".join(f"{k} ({v})" for k, v in about["skipped"].items()) + "."]
    if about.get("importance"):
        lines += ["", "## What matters", "", *[f"- {r['column']}: {r['score']:.3g}" for r in about["importance"]]]
    lines += ["", "## Limits", "", "Scores hold for rows like those trained on; `predict` says where new rows differ. The model finds what goes together, not what causes what.", "", f"Data: {about['fingerprint']}." if about.get("fingerprint") else ""]
    if about.get("notes"):
        lines += ["", "## Notes", "", *[f"- {n}" for n in about["notes"]]]
    return "\n".join(lines) + "\n"


def summarised(df: DataFrame, most: int = 20_000, preview: int = 30) -> dict:
    """What is told of a table that has just been handed in: columns and kinds by a sample of at most most rows, a target
    that may be meant (the last column that could be one), and the first rows.
    """
    from tabulon.operators.profile import infer_kinds

    n = df.count()
    some = df if n <= most else df.sample(False, most / n, 42)
    kinds = infer_kinds(some)
    fit = [k.name for k in kinds if k.kind in ("numeric", "categorical")]
    named = [c for c in fit if c.lower() in ("target", "label", "y", "class", "outcome")]
    rows = [plain(r.asDict()) for r in df.limit(preview).collect()]
    return {"rows": n, "columns": [{"column": k.name, "kind": k.kind, "missing": k.n_missing, "distinct": k.n_unique} for k in kinds], "target": (named or fit or [None])[-1], "preview": rows}


def compare_runs(runs: list[dict]) -> list[dict]:
    """One row for each attribute and a column for each run; says where the same target was trained on different data."""
    names = sorted({k for r in runs for k in r if k != "name"})
    rows = [{"attribute": k, **{r["name"]: r.get(k) for r in runs}} for k in names]
    by_target: dict[object, set] = {}
    for r in runs:
        by_target.setdefault(r.get("target"), set()).add(r.get("fingerprint"))
    if any(len(v) > 1 for v in by_target.values()):
        rows.append({"attribute": "note", **{r["name"]: "data differ" for r in runs}})
    return rows
