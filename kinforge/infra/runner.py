"""Steps with declared inputs and outputs, run in dependency order.

``python -m kinforge.infra.runner query=<name> sf_dir=<folder> [section.key=value]``
runs one registered query and prints its first rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from kinforge.infra.artifacts import ArtifactMissing, ArtifactRegistry
from kinforge.infra.config import Config, load_config


@dataclass(frozen=True)
class Step:
    """A named function of (registry, config) with what it needs and makes."""

    name: str
    run: Callable[[ArtifactRegistry, Config], None]
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()


def producer_of(steps: list[Step], artifact: str) -> Step | None:
    return next((s for s in steps if artifact in s.produces), None)


def order(steps: list[Step]) -> list[Step]:
    """Dependency order; raises on a cycle."""
    done: list[Step] = []
    made: set[str] = set()
    rest = list(steps)
    internal = {a for s in steps for a in s.produces}
    while rest:
        ready = [s for s in rest if all(r in made or r not in internal for r in s.requires)]
        if not ready:
            raise ValueError(f"steps {[s.name for s in rest]} wait for each other")
        for s in ready:
            done.append(s)
            made |= set(s.produces)
            rest.remove(s)
    return done


def run_step(step: Step, registry: ArtifactRegistry, config: Config) -> None:
    """Check that all inputs exist in the run's tier before anything starts."""
    absent = [r for r in step.requires if not registry.exists(r, config.run.tier)]
    if absent:
        raise ArtifactMissing(f"{step.name} needs {absent}")
    step.run(registry, config)


def run_all(steps: list[Step], registry: ArtifactRegistry, config: Config, upto: str | None = None) -> list[str]:
    names = []
    for step in order(steps):
        run_step(step, registry, config)
        names.append(step.name)
        if step.name == upto:
            break
    return names


def parse_argv(argv: list[str]) -> tuple[dict[str, str], list[str]]:
    """(plain settings, dotted overrides) of key=value tokens."""
    plain, dotted = {}, []
    for token in argv:
        key, sep, value = token.partition("=")
        if not sep:
            raise ValueError(f"{token!r} is not key=value")
        if "." in key:
            dotted.append(token)
        else:
            plain[key] = value
    return plain, dotted


def main(argv: list[str] | None = None) -> int:
    plain, dotted = parse_argv(sys.argv[1:] if argv is None else argv)
    load_config(plain.get("config"), dotted)
    from kinforge.plans import registry
    from kinforge.session import get_session

    if plain.get("query") not in registry.QUERIES:
        print("queries:", *sorted(registry.QUERIES))
        return 2
    spark = get_session(master=plain.get("master"))
    registry.QUERIES[plain["query"]](spark, plain["sf_dir"]).show(int(plain.get("rows", 20)), truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
