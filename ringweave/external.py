"""External programs, from the driver or from jobs."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable, Iterable

#: Fixed value: what a failed fork leaves on stderr; always worth a retry.
NO_CHILDREN = "No child processes"


class InvokeError(RuntimeError):
    def __init__(self, status: int, out: str, err: str):
        super().__init__(f"exit status {status}\nstdout:\n{out}\nstderr:\n{err}")
        self.status, self.stdout, self.stderr = status, out, err


def invoke(program: Iterable[str], transientErrors: Iterable[str] = (), maxRetries: int = 20, *, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:  # noqa: N803
    """(stdout, stderr) of a program. A failure whose stderr holds a transient error is tried again after 1, 2, 3 ... s."""
    program = [str(p) for p in program]
    if os.sep in program[0] and not os.access(program[0], os.X_OK):
        raise FileNotFoundError(f"{program[0]} is missing or can't be executed")
    passing = [*transientErrors, NO_CHILDREN]
    for attempt in range(maxRetries + 1):
        done = subprocess.run(program, capture_output=True, text=True, check=False)
        if done.returncode == 0:
            return done.stdout, done.stderr
        if attempt == maxRetries or not any(e in done.stderr for e in passing):
            raise InvokeError(done.returncode, done.stdout, done.stderr)
        sleep(attempt + 1)
    raise AssertionError


def run_with_stdin(program: Iterable[str], given: str) -> tuple[int, str, str]:
    """Status, stdout and stderr; a failure doesn't raise."""
    done = subprocess.run([str(p) for p in program], input=given, capture_output=True, text=True, check=False)
    return done.returncode, done.stdout, done.stderr
