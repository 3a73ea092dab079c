"""Plans of Python jobs that queries and examples share."""

from __future__ import annotations

import math
import random

from .plans.nodes import Frame, Job, Module, Reducer


class Add(Job):
    def handleWork(self, work):  # noqa: N802
        self.emit(work + self.config.get("by", 1))


class Twice(Job):
    def handleWork(self, work):  # noqa: N802
        self.emit(work)
        self.emit(work)


class Total(Reducer):
    def handleInit(self, store):  # noqa: N802
        store.value = 0

    def handleAdd(self, store, work):  # noqa: N802
        store.value += work

    def handleJoin(self, store, other):  # noqa: N802
        store.value += other.value

    def handleDone(self, store):  # noqa: N802
        self.emit(store.value)


class Scale(Job):
    """A row's `value` times `by`, plus `plus`."""

    def handleWork(self, work):  # noqa: N802
        self.emit(work | {"value": work["value"] * self.config.get("by", 1) + self.config.get("plus", 0)})


class Under(Job):
    """A row whose `value` is below `below` goes to `again`, any other to `done`."""

    def handleWork(self, work):  # noqa: N802
        self.emit(work, "again" if work["value"] < self.config["below"] else "done")


class Through(Frame):
    """Adds the numbers from one to the first row's `value`."""

    def handleFirst(self, store, first):  # noqa: N802
        store.first, store.total, store.at = first, 0, 0

    def handleNext(self, store, work):  # noqa: N802
        store.total += work["value"]

    def handleDone(self, store):  # noqa: N802
        if store.at < store.first["value"]:
            store.at += 1
            self.recur(store.first | {"value": store.at})
        else:
            self.emit(store.first | {"value": store.total})


class Kept(Frame):
    """Emits its first item."""

    def handleFirst(self, store, first):  # noqa: N802
        store.first = first

    def handleDone(self, store):  # noqa: N802
        self.emit(store.first)


class Longest(Frame):
    """Over all rows: the first opens the frame; its number grows until it is no less than the rows' sum."""

    def handleFirst(self, store, first):  # noqa: N802
        store.sum, store.grown = first, 1

    def handleNext(self, store, work):  # noqa: N802
        if isinstance(work, tuple):
            store.grown = work[0]
        else:
            store.sum += work

    def handleDone(self, store):  # noqa: N802
        if store.grown < store.sum:
            self.recur((store.grown,))
        else:
            self.emit(store.grown)


class Doubled(Job):
    def handleWork(self, work):  # noqa: N802
        self.emit((work[0] * 2,))


class UpTo(Total):
    """Recurs its sum until it reaches `value`; outputs below three recur as threes (a fixed rule of the golden results)."""

    def handleAdd(self, store, work):  # noqa: N802
        if work < 3:
            self.recur(3)
        store.value += work

    def handleDone(self, store):  # noqa: N802
        if store.value < self.config["value"]:
            self.recur(store.value)
        else:
            self.emit(store.value)


def nested_rings() -> Module:
    """Five levels of rings, with recurrence in the middle."""
    innermost = Module([Twice(), Module([Add()], Total())], Total())
    recurring = Module([Add(), Twice(), Module([Add()], Total())], UpTo({"value": 1000}))
    middle = Module([Add(), recurring, innermost], Total())
    return Module([Add(), Module([Twice(), middle], Total())])


class Evolution(Frame):
    """Keeps the best of a population of small networks and breeds from them until the error is small."""

    def handleFirst(self, store, first):  # noqa: N802
        rng = random.Random(first)
        store.seed, store.generation, store.rng, store.scored = first, 0, rng, []
        for _ in range(self.config["population"]):
            self.recur([rng.uniform(-3, 3) for _ in range(9)])

    def handleNext(self, store, work):  # noqa: N802
        store.scored.append(work)

    def handleDone(self, store):  # noqa: N802
        best = sorted(store.scored)[: self.config["keep"]]
        if best[0][0] < self.config["error"] or store.generation >= self.config["generations"]:
            self.emit({"seed": store.seed, "generations": store.generation, "error": best[0][0]})
            return
        store.generation, store.scored = store.generation + 1, list(best)
        for i in range(self.config["population"] - len(best)):
            if i % 4 == 0:  # newcomers keep the search from settling on a poor network
                self.recur([store.rng.uniform(-3, 3) for _ in range(9)])
                continue
            a, b = store.rng.choice(best)[1], store.rng.choice(best)[1]
            self.recur([store.rng.choice(pair) + store.rng.gauss(0, store.rng.choice((0.1, 0.5, 1.5))) for pair in zip(a, b, strict=True)])


class Score(Job):
    """A network's squared error on exclusive or."""

    def handleWork(self, work):  # noqa: N802
        def out(x, y):
            h1, h2 = math.tanh(work[0] * x + work[1] * y + work[2]), math.tanh(work[3] * x + work[4] * y + work[5])
            return math.tanh(work[6] * h1 + work[7] * h2 + work[8])

        self.emit((sum((out(x, y) - (x != y)) ** 2 for x in (0, 1) for y in (0, 1)), work))


def evolution() -> Module:
    return Module([Module([Score()], Evolution({"population": 60, "keep": 12, "error": 0.05, "generations": 200}))])
