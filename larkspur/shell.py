"""A batch shell: statements and dot-commands in, text out.

    python -m larkspur.shell DATABASE < statements.sql
"""

from __future__ import annotations

import sys

from .formatter import ListFormatter
from .plans.parser import parse, split_statements
from .session import Engine


class Shell:
    def __init__(self, engine: Engine):
        self.engine, self.format, self.done = engine, ListFormatter(), False

    def process(self, text: str) -> str:
        """Run a batch. A statement that fails prints its error, and the batch goes on."""
        out: list[str] = []
        held = ""
        for line in text.splitlines():
            stripped = line.strip()
            if not held.strip() and (not stripped or stripped.startswith("--")):
                continue
            if not held.strip() and stripped.startswith("."):
                out += self.command(stripped)
                if self.done:
                    break
                continue
            complete, held = split_statements(f"{held}\n{line}" if held else line)
            out += [r for r in map(self.statement, complete) if r is not None]
        return "".join(f"{x}\n" for x in out)

    def command(self, line: str) -> list[str]:
        name, _, rest = line.partition(" ")
        rest = rest.strip()
        match name:
            case ".headers" | ".header":
                self.format.headers = rest.lower() in ("on", "yes", "1", "true")
            case ".mode":
                if rest not in ("", "list"):
                    return [f"Error: mode {rest!r} is not supported"]
            case ".separator":
                self.format.separator = rest.strip("\"'") or "|"
            case ".tables":
                return ["\n".join(self.engine.tables())]
            case ".quit" | ".exit":
                self.done = True
            case _:
                return [f"Error: unknown command: {name}"]
        return []

    def statement(self, sql: str) -> str | None:
        try:
            if parse(sql).explain:
                return self.engine.explain(sql).rstrip()
            df = self.engine.plan(sql)
            rows = df.collect()
            return self.format.rows(df.columns, rows) if rows else None
        except Exception as e:
            return f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("larkspur").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sys.stdout.write(Shell(Engine(spark, sqlite=argv[0])).process(sys.stdin.read()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
