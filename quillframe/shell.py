"""An interactive shell: statements end with ``;`` and may span lines."""

from __future__ import annotations

import sys
import time
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from quillframe.engine import Engine
from quillframe.plans.lexer import SqlError, statements
from quillframe.printer import footer, render

HELP = """Statements end with ;
  LOAD 'file.csv' AS t    SHOW TABLES    SHOW INDEXES    DESCRIBE t
  SELECT ... FROM t [JOIN ...] [WHERE ...] [GROUP BY ...] [HAVING ...] [ORDER BY ...] [LIMIT n]
  CREATE TABLE t (c TYPE, ...)    INSERT INTO t VALUES (...)    UPDATE t SET ... [WHERE ...]
  DELETE FROM t [WHERE ...]    ALTER TABLE t ADD|DROP|RENAME ...    DROP TABLE t
  CREATE INDEX i ON t(c)    DROP INDEX i    EXPORT (SELECT ...) TO 'file' [FORMAT CSV|JSON]
Commands: .help .tables .stats .clear .quit .exit"""


class Shell:
    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.engine, self.out = engine, out
        self.stats = True
        self.waiting = ""

    def say(self, text: str) -> None:
        print(text, file=self.out)

    @property
    def prompt(self) -> str:
        return "   ...> " if self.waiting.strip() else "quill> "

    def line(self, text: str) -> bool:
        """Takes one line; False at the end."""
        if not self.waiting.strip() and text.strip().startswith("."):
            return self.command(text.strip().lower())
        ready, self.waiting = statements(self.waiting + text + "\n")
        for sql in ready:
            self.run(sql)
        return True

    def command(self, name: str) -> bool:
        if name in (".quit", ".exit"):
            return False
        if name == ".help":
            self.say(HELP)
        elif name == ".tables":
            self.run("SHOW TABLES")
        elif name == ".stats":
            self.stats = not self.stats
            self.say(f"Statistics {'on' if self.stats else 'off'}.")
        elif name == ".clear":
            self.engine.catalog.clear()
            self.say("All tables and indexes removed.")
        else:
            self.say(f"Error: unknown command {name}")
        return True

    def run(self, sql: str) -> None:
        began = time.perf_counter()
        try:
            done = self.engine.query(sql)
            if done.df is None:
                self.say(done.message or "")
                return
            rows = done.rows()
            self.say(render(done.df.columns, rows))
            if self.stats:
                self.say(footer(len(rows), (time.perf_counter() - began) * 1000, done.scanned()))
        except (SqlError, PySparkException) as e:
            self.say(f"Error: {str(e).splitlines()[0]}")


def main() -> None:
    shell = Shell(Engine(SparkSession.builder.getOrCreate()))
    while True:
        try:
            if not shell.line(input(shell.prompt)):
                break
        except (EOFError, KeyboardInterrupt):
            break


if __name__ == "__main__":
    main()
