"""A small scoring service: GET /health, POST /predict with a list of records, POST /forecast where a forecaster is served."""

from __future__ import annotations

import hmac
import json
import shutil
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.encode import missing_columns
from tabulon.operators.forecast import Forecaster
from tabulon.operators.train import Trained
from tabulon.sources.writers import plain

MOST_ROWS, MOST_PERIODS = 100_000, 1_000


def score_records(spark: SparkSession, model: Trained, records: list[dict]) -> list[dict]:
    """Predictions of records, in their order; extra keys are ignored, missing ones are blank."""
    if not records or len(records) > MOST_ROWS:
        raise ValueError(f"1 to {MOST_ROWS} records are needed")
    inputs = model.encoding.inputs()
    names = {k for r in records for k in r}
    if not names & set(inputs):
        raise ValueError(f"none of the inputs is there: {', '.join(inputs)}")
    rows = [(k, *[None if r.get(c) is None else str(r[c]) for c in inputs]) for k, r in enumerate(records)]
    df = spark.createDataFrame(rows, "row_ long, " + ", ".join(f"`{c}` string" for c in inputs))
    missing_columns(df, inputs)
    out = [r.asDict() for r in model.predict(df, ["row_"]).orderBy("row_").collect()]
    return [{k: v for k, v in r.items() if k != "row_"} for r in out]


def forecast_records(history: DataFrame, forecaster: Forecaster, body: dict) -> list[dict]:
    """The next periods after history. body may hold horizon, groups (unknown ones are an error) and plans, a list of
    records with the date, the group and inputs.
    """
    horizon = int(body.get("horizon") or forecaster.horizon)
    if not 0 < horizon <= MOST_PERIODS:
        raise ValueError(f"1 to {MOST_PERIODS} periods can be forecast")
    future = None
    if body.get("plans"):
        if len(body["plans"]) > MOST_ROWS:
            raise ValueError(f"at most {MOST_ROWS} plans are taken")
        names = [forecaster.date, *forecaster.group, *forecaster.inputs]
        rows = [tuple(None if r.get(c) is None else str(r[c]) for c in names) for r in body["plans"]]
        text = history.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))
        kinds = dict(history.dtypes)
        future = text.select(*[F.col(f"`{c}`").cast("timestamp_ntz" if c == forecaster.date else kinds[c]).alias(c) for c in names])
    found = forecaster.forecast(history, future, body.get("groups"), horizon)
    return [r.asDict() for r in found.orderBy(*forecaster.group, "step").collect()]


def handler(spark: SparkSession, model: Trained | None, key: str | None, forecaster: Forecaster | None = None, history: DataFrame | None = None):  # noqa: ANN201
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object) -> None:
            raw = json.dumps(plain(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            about = {"status": "ok", "model": model.key if model else None, "task": model.task if model else "forecast"}
            self._send(*((200, about) if self.path == "/health" else (404, {"error": "not found"})))

        def do_POST(self) -> None:  # noqa: N802
            if key and not hmac.compare_digest(self.headers.get("X-API-Key", ""), key):
                return self._send(401, {"error": "a key is needed"})
            if not (self.path == "/predict" and model or self.path == "/forecast" and forecaster):
                return self._send(404, {"error": "not found"})
            try:
                records = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                if self.path == "/forecast":
                    return self._send(200, forecast_records(history, forecaster, records))
                return self._send(200, score_records(spark, model, records if isinstance(records, list) else [records]))
            except (ValueError, TypeError, AttributeError) as e:
                return self._send(400, {"error": str(e)})

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(spark: SparkSession, model: Trained | None, port: int = 8000, key: str | None = None, forecaster: Forecaster | None = None, history: DataFrame | None = None, host: str = "127.0.0.1") -> None:
    ThreadingHTTPServer((host, port), handler(spark, model, key, forecaster, history)).serve_forever()


def deploy(folder: str | Path, model: str | Path, port: int = 8000) -> Path:
    """A folder from which an image of the service can be built: the model, the library's sources, a Dockerfile and a note."""
    out, library = Path(folder), Path(__file__).resolve().parents[1]
    out.mkdir(parents=True, exist_ok=True)
    shutil.copytree(model, out / "model", dirs_exist_ok=True)
    shutil.copytree(library, out / library.name, dirs_exist_ok=True, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (out / "requirements.txt").write_text("pyspark==4.1.2\npyarrow\npandas\nnumpy\n")
    (out / "Dockerfile").write_text(f"""FROM python:3.13-slim
RUN apt-get update && apt-get install -y --no-install-recommends default-jre-headless && rm -rf /var/lib/apt/lists/*
WORKDIR /app
COPY requirements.txt .
RUN pip install --no-cache-dir -r requirements.txt
COPY . .
EXPOSE {port}
CMD ["python", "-m", "{library.name}.cli", "serve", "model", "--port", "{port}", "--host", "0.0.0.0"]
""")
    (out / "README.md").write_text(f"docker build -t scorer . && docker run -p {port}:{port} scorer\n\nPOST /predict takes a list of records, GET /health says whether the service is up. Set a key with --key before opening the port to others.\n")
    return out
