"""A plugin's run in a process of its own, with bounds on processor time, memory and waiting.

The function travels by cloudpickle; its tool calls and answers travel as JSON lines. The process may use ``CPU_S`` seconds of
processor time and ``MEMORY`` bytes beyond what it starts with, and is waited for ``WAIT_S`` seconds, without the time that
tools take. What goes beyond ends the process, not the engine.
"""

from __future__ import annotations

import base64
import json
import os
import select
import subprocess
import sys
import time
from collections.abc import Callable
from typing import Any

CPU_S, MEMORY, WAIT_S = 10, 256 << 20, 30.0


class Trap(Exception):
    """The plugin failed or went beyond its bounds."""


class BadAnswer(Exception):
    """The answer isn't JSON, or is too large."""


def run(function: Callable, given: Any, call: Callable[[str, dict], Any], most_bytes: int, cpu_s: int = CPU_S, memory: int = MEMORY, wait_s: float = WAIT_S) -> Any:
    """The answer of ``function(call, given)`` in a process of its own."""
    from pyspark import cloudpickle

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([here, *[p for p in sys.path if p]])}
    child = subprocess.Popen([sys.executable, "-m", "noteloom.plans.sandbox"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
    left, held = wait_s, b""
    try:
        order = {"function": base64.b64encode(cloudpickle.dumps(function)).decode(), "given": given, "cpu_s": cpu_s, "memory": memory}
        _send(child, order)
        while True:
            while b"\n" not in held:
                start = time.monotonic()
                ready, _, _ = select.select([child.stdout], [], [], max(0.0, left))
                left -= time.monotonic() - start
                if not ready:
                    raise Trap(f"no answer within {wait_s:g} seconds")
                got = os.read(child.stdout.fileno(), 1 << 16)
                if not got:
                    raise Trap(f"the process ended with {child.wait()}: out of processor time or memory")
                held += got
                if len(held) > most_bytes + 1000:
                    raise BadAnswer(f"the answer is larger than {most_bytes} characters")
            line, _, held = held.partition(b"\n")
            said = json.loads(line)
            if "call" in said:
                try:
                    _send(child, {"answer": call(*said["call"])})
                except RuntimeError as e:
                    raise Trap(f"RuntimeError: {e}") from None
            elif "trap" in said:
                raise Trap(said["trap"])
            elif "bad" in said:
                raise BadAnswer(said["bad"])
            else:
                return said["done"]
    finally:
        child.kill()
        child.wait()
        child.stdin.close()
        child.stdout.close()


def _send(child: subprocess.Popen, what: dict) -> None:
    try:
        child.stdin.write(json.dumps(what, default=str).encode() + b"\n")
        child.stdin.flush()
    except BrokenPipeError:
        raise Trap("the process ended") from None


def _serve() -> None:
    """The process's side."""
    import pickle
    import resource

    out = os.fdopen(os.dup(1), "w")
    os.dup2(os.open(os.devnull, os.O_WRONLY), 1)  # what the plugin prints is no message

    def say(**what: Any) -> None:
        out.write(json.dumps(what) + "\n")
        out.flush()

    def call(tool: str, args: dict | None = None) -> Any:
        say(call=[tool, args or {}])
        return json.loads(sys.stdin.readline())["answer"]

    order = json.loads(sys.stdin.readline())
    function = pickle.loads(base64.b64decode(order["function"]))
    with open("/proc/self/statm") as f:
        now = int(f.read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (now + order["memory"],) * 2)
    used = resource.getrusage(resource.RUSAGE_SELF)
    resource.setrlimit(resource.RLIMIT_CPU, (int(used.ru_utime + used.ru_stime) + order["cpu_s"],) * 2)
    try:
        answer = function(call, order["given"])
    except Exception as e:
        say(trap=f"{type(e).__name__}: {e}"[:1000])
        return
    try:
        say(done=answer)
    except (TypeError, ValueError) as e:
        say(bad=str(e)[:1000])


if __name__ == "__main__":
    _serve()
