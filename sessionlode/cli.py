"""Command line: index, sessions, session, serve, version, help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sessionlode import __version__
from sessionlode.operators.chunking import describe
from sessionlode.plans.index import Index
from sessionlode.plans.progress import Progress
from sessionlode.plans.search import Searcher
from sessionlode.plans.server import answer
from sessionlode.plans.tools import Tools
from sessionlode.schemas import NO_PROJECT
from sessionlode.sources import parts as P
from sessionlode.sources.config import Config, load
from sessionlode.sources.embedder import EmbeddingCache, HttpEmbedder
from sessionlode.sources.history import History

USAGE_ERROR = 2


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sessionlode", description="Search over session history.")
    commands = parser.add_subparsers(dest="command")
    index = commands.add_parser("index", help="bring the index up to date")
    index.add_argument("--project", default="")
    index.add_argument("--limit", type=int, default=0)
    index.add_argument("--embed-pause", type=float, default=0.0, help="seconds between an executor's calls")
    index.add_argument("--no-lexical", action="store_true", help="leave the second lexical index out")
    index.add_argument("--quiet", action="store_true", help="no progress on standard error")
    index.add_argument("--backfill", action="store_true", help="embed what is pending")
    commands.add_parser("sessions", help="totals and the newest sessions")
    session = commands.add_parser("session", help="one session's parts")
    session.add_argument("id")
    session.add_argument("--dialog-limit", type=int, default=40)
    serve = commands.add_parser("serve", help="answer tool calls: JSON-RPC messages, or plain objects {tool, args}, one a line")
    serve.add_argument("--no-lexical", action="store_true")
    commands.add_parser("version", aliases=["--version", "-v"])
    commands.add_parser("help")
    return parser


def summary_lines(history: History) -> list[str]:
    """Totals over all sessions in one pass per table, and the last five."""
    compacted = history.compaction().count()
    totals = [("sessions", history.session.count()), ("messages", history.message.count()), ("parts", history.parts().count()), ("projects", history.project.count()), ("compacted", compacted)]
    lines = [f"{name + ':':<10} {n}" for name, n in totals] + ["--- last 5 sessions ---"]
    for s in history.located(history.sessions()).orderBy(F.desc("time_updated"), "id").limit(5).collect():
        title = s["title"] if len(s["title"] or "") <= 24 else s["title"][:24] + "..."
        lines.append(f"  {s['id'][:12]}  {title or '':<16}  {s['agent']:<14}  {s['project_path'] or NO_PROJECT}  [{s['time_updated']}]")
    return lines


def session_lines(history: History, session_id: str, limit: int) -> list[str]:
    s = history.get_session(session_id)
    parts = history.parts(session_id)
    n = parts.count()
    mark = history.compaction(parts).collect()
    path = history.located(history.session.where(F.col("id") == session_id)).first()["project_path"]
    info = history.session.where(F.col("id") == session_id).select(P.model(F.col("model")).alias("m")).first()["m"]
    lines = [
        f"session:   {s['id']}", f"title:     {s['title']}", f"project:   {path} ({s['project_id']})", f"agent:     {s['agent'] or ''}", f"model:     {info['providerID']}/{info['id']}",
        f"time:      {s['time_created']} .. {s['time_updated']}", f"parts:     {n}", f"compacted: {str(bool(mark)).lower()} (tail={mark[0]['tail_start_id'] if mark else ''})", f"--- dialog (first {limit} parts) ---",
    ]
    rows = parts.where(F.col("position") < limit).select("position", describe(F.col("payload"), F.col("type")).alias("line")).orderBy("position")
    lines += [f"[{r['position']}] {r['line']}" for r in rows.collect()]
    return lines + ([f"... {n - limit} more parts"] if n > limit else [])


def _embedder(config: Config) -> HttpEmbedder | None:
    embedder = HttpEmbedder(config.embed_url, config.embed_model, config.embed_dim)
    return embedder if embedder.ping() else None


def main(argv: list[str] | None = None, out=print) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = _parser()
    if not argv or argv[0] in ("help", "-h", "--help"):
        out(parser.format_help())
        return 0 if argv else USAGE_ERROR
    if argv[0] in ("version", "--version", "-v"):
        out(__version__)
        return 0
    try:
        args = parser.parse_args(argv)
    except SystemExit:
        return USAGE_ERROR
    config = load()
    spark = SparkSession.builder.appName("sessionlode").getOrCreate()
    history = History.open(spark, config.source)
    if args.command == "sessions":
        out("\n".join(summary_lines(history)))
    elif args.command == "session":
        out("\n".join(session_lines(history, args.id, args.dialog_limit)))
    elif args.command == "index":
        embedder = _embedder(config)
        index = Index.open(spark, config.index, config.embed_dim, config.embed_model)
        cache = EmbeddingCache(spark, config.embed_cache) if config.embed_cache else None
        stats = index.run(history, args.project or None, args.limit or None, embedder, not args.no_lexical and config.lexical_index, cache, args.backfill, args.embed_pause, None if args.quiet else Progress(spark))
        out(json.dumps(vars(stats)))
    elif args.command == "serve":
        index = Index.open(spark, config.index, config.embed_dim, config.embed_model)
        tools = Tools(history, Searcher(index, _embedder(config), not args.no_lexical and config.lexical_index))
        for line in sys.stdin:
            try:
                request = json.loads(line)
                if "jsonrpc" in request:
                    if (reply := answer(tools, line)) is not None:
                        out(reply)
                    continue
                out(tools.call(request.get("tool", ""), request.get("args") or {}))
            except (ValueError, LookupError) as error:
                out(json.dumps({"error": str(error)}))
    return 0
