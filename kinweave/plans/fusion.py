"""The whole batch plan: control log and reports in, family records and dead letters out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import families, routing
from ..operators.lifecycle import Lifecycle, lifecycle
from ..session import materialize

# Which seeds go with which range of reports unless told otherwise.
DEFAULT_SEEDS = {"replay": "own", "resume": "carry"}


@dataclass
class Fusion:
    """Outputs of one run, composed when asked for. ``seeds`` and ``records`` run small jobs to size their work."""

    lifecycle: Lifecycle
    reports: DataFrame
    mode: str = "replay"
    seed_rule: str | None = None

    @property
    def members(self) -> DataFrame:
        return self.lifecycle.members

    @cached_property
    def routed(self) -> DataFrame:
        """Written once, as what is computed from it reads it several times."""
        return materialize(self._route())

    def _route(self) -> DataFrame:
        return routing.route(self.reports, self.members, self.mode)

    def _routed_once(self) -> DataFrame:
        """For a consumer that reads the rows once: the written table only where there is one already."""
        return self.routed if "routed" in self.__dict__ else self._route()

    @cached_property
    def accepted(self) -> DataFrame:
        return routing.accepted(self._routed_once())

    @cached_property
    def rejected_reports(self) -> DataFrame:
        return routing.rejected(self._routed_once())

    @property
    def _rule(self) -> str:
        return self.seed_rule or DEFAULT_SEEDS[self.mode]

    @cached_property
    def seeds(self) -> DataFrame:
        return families.seeds(self.routed, self.members, self._rule)

    @cached_property
    def records(self) -> DataFrame:
        # a lone son is always the reporter, so only sons of larger versions can show a seed
        showing = self.members.filter("n_sons > 1")
        if self._rule == "carry":  # needs the whole history of those sons
            showing = self.members.join(showing.select("system_uuid").distinct(), "system_uuid", "left_semi")
        seeds = families.seeds(self.routed, showing, self._rule)
        return families.family_records(self.routed, self.members, seeds)

    @cached_property
    def snapshot(self) -> DataFrame:
        return families.family_snapshot(self.routed, self.members, self.seeds)


def fuse(control: DataFrame, reports: DataFrame, mode: str = "replay", seeds: str | None = None) -> Fusion:
    """Run the lifecycle of a control log and attach the reports to it."""
    return Fusion(lifecycle(control), reports, mode, seeds)
