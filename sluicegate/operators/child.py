"""A child process that scores batches and can be killed: a model that never returns leaves nothing behind."""

from __future__ import annotations

import ctypes
import multiprocessing
import signal
from collections.abc import Callable

from pyspark import cloudpickle

#: Seconds that a child may take to load its model.
START_SECONDS = 120.0


class Late(Exception):
    """No answer within the time; the child is gone."""


class Failed(Exception):
    """What the child raised, by its kind alone: its words may hold text."""


def _die_with_parent() -> None:
    """Where the system can, end this process when the worker ends, however it ends (1: the option's fixed number)."""
    try:
        ctypes.CDLL(None).prctl(1, signal.SIGKILL)
    except (AttributeError, OSError):
        pass  # a closed pipe ends it too, once it reads again


def serve(pipe, packed: bytes) -> None:
    """Answer batches until the pipe closes: (True, answer) or (False, kind of error)."""
    _die_with_parent()
    try:
        score = cloudpickle.loads(packed)()
        pipe.send((True, None))
    except BaseException as e:  # a model may end in any way
        pipe.send((False, type(e).__name__))
        return
    while True:
        try:
            batch = pipe.recv()
        except EOFError:
            return
        try:
            answer = (True, score(batch))
        except Exception as e:
            answer = (False, type(e).__name__)
        try:
            pipe.send(answer)
        except (TypeError, ValueError, AttributeError):  # an answer that can't be sent is a bad one
            pipe.send((True, None))


class Child:
    """Scores in one process of its own, which is started when it is needed and anew after it was killed."""

    def __init__(self, load: Callable, seconds: float, start_seconds: float = START_SECONDS):
        self.packed, self.seconds, self.start_seconds = cloudpickle.dumps(load), seconds, start_seconds
        self.process = self.pipe = None

    def __call__(self, texts: list[str]):
        if self.process is None:
            self._start()
        return self._ask(texts, self.seconds)

    def _start(self) -> None:
        context = multiprocessing.get_context("spawn")  # a fork would copy the worker's threads and locks
        self.pipe, end = context.Pipe()
        self.process = context.Process(target=serve, args=(end, self.packed), daemon=True)
        self.process.start()
        end.close()
        self._answer(self.start_seconds)

    def _ask(self, texts: list[str], seconds: float):
        try:
            self.pipe.send(texts)
        except OSError:
            self.close()
            raise Failed("ChildDied") from None
        return self._answer(seconds)

    def _answer(self, seconds: float):
        if not self.pipe.poll(seconds):
            self.close()
            raise Late
        try:
            fine, told = self.pipe.recv()
        except (EOFError, OSError):  # it ended by itself
            self.close()
            raise Failed("ChildDied") from None
        if not fine:
            raise Failed(told)
        return told

    def close(self) -> None:
        """Kill the child, if there is one, and wait until it is gone."""
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process.close()
            self.pipe.close()
            self.process = self.pipe = None
