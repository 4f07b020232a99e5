"""Access scope: predicates that fail closed, permits, inheritance, scope resolution."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obspark.functions.numeric import LEVELS, level_rank


# What each type of principal may do.
USER_CAPABILITIES = ("observation.search", "observation.read_detail", "observation.read_locator", "video.playback")
SERVICE_CAPABILITIES = ("analysis.submit", "analysis.rerun")
ADMIN_CAPABILITIES = (*USER_CAPABILITIES, *SERVICE_CAPABILITIES, "analysis.publish", "camera.manage", "policy.manage", "user.manage", "audit.read", "runtime.manage")


def capabilities(principal_type: Column) -> Column:
    """capabilities by the type of a principal; unknown types are users."""
    listed = lambda values: F.array(*map(F.lit, values))
    return F.when(principal_type == "admin", listed(ADMIN_CAPABILITIES)).when(principal_type == "service_account", listed(USER_CAPABILITIES + SERVICE_CAPABILITIES)).otherwise(listed(USER_CAPABILITIES))


def may(principal_type: Column, capability: Column) -> Column:
    """Whether a principal of the type has the capability; nobody has an unknown one."""
    return F.array_contains(capabilities(principal_type), capability)


@dataclass(frozen=True)
class Scope:
    """What a principal may see; an empty list allows nothing."""

    tenant_id: str
    cameras: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    policies: tuple[str, ...] = ()
    level: str = "public"
    capabilities: tuple[str, ...] = field(default=("observation.search",))
    principal: str = ""

    def digest(self) -> str:
        """what a search session is bound to, the principal included: a mark and 32 hex digits of the canonical JSON."""
        body = {
            "tenant_id": self.tenant_id, "principal_id": self.principal, "allowed_camera_ids": sorted(self.cameras), "allowed_location_ids": sorted(self.locations), "allowed_access_policy_ids": sorted(self.policies), "max_security_level": self.level, "capabilities": sorted(self.capabilities),
        }
        return "scope_" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]

    def require(self, capability: str) -> None:
        """Raises unless the scope has the capability."""
        if capability not in self.capabilities:
            raise PermissionError(f"capability {capability} is not in scope")


def _listed(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isin(*values) if values else F.lit(False)


def observation_permit(scope: Scope) -> Column:
    """Tenant, camera, location, policy and level; false where any list is empty."""
    return (F.col("tenant_id") == scope.tenant_id) & _listed("camera_id", scope.cameras) & _listed("location_id", scope.locations) & _listed("access_policy_id", scope.policies) & F.col("security_level").isin(*LEVELS[: LEVELS.index(scope.level) + 1])


def authorized(df: DataFrame, scope: Scope) -> DataFrame:
    """Observations that the scope permits."""
    return df.filter(observation_permit(scope))


def authorized_videos(df: DataFrame, scope: Scope) -> DataFrame:
    """Videos by tenant, camera and policy."""
    return df.filter((F.col("tenant_id") == scope.tenant_id) & _listed("camera_id", scope.cameras) & _listed("access_policy_id", scope.policies))


def stricter(a: Column, b: Column) -> Column:
    """the stricter rank; a missing one does not count."""
    return F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))


def permits_principal(principal: str, roles: list[str], groups: list[str]) -> Column:
    """A denied principal never passes; else the principal, a role or a group must be allowed."""
    some = lambda c, values: F.arrays_overlap(F.col(c), F.array(*map(F.lit, values))) if values else F.lit(False)
    return F.when(F.array_contains("denied_principals", principal), False).otherwise(F.array_contains("allowed_principals", principal) | some("allowed_roles", roles) | some("allowed_groups", groups))


def inherited(videos: DataFrame, cameras: DataFrame, locations: DataFrame, default: str) -> DataFrame:
    """Policy of a video: its own, its camera's, the camera's location's, the default; empty strings do not count."""
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = videos.join(cameras.withColumnRenamed("policy_id", "camera_policy"), "camera_id", "left").join(locations.withColumnRenamed("policy_id", "location_policy"), "location_id", "left")
    return joined.withColumn("effective_policy", F.coalesce(own("policy_id"), own("camera_policy"), own("location_policy"), F.lit(default)))


def resolve_scope(policies: DataFrame, locations: DataFrame, cameras: DataFrame, principal: str, roles: list[str], groups: list[str]) -> DataFrame:
    """One row with the permitted policies, the locations and cameras they reach, and the highest level (public if none)."""
    mine = policies.filter(permits_principal(principal, roles, groups)).select("policy_id", "security_level")
    where = locations.join(mine.select("policy_id"), "policy_id", "left_semi").select("location_id")
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    reached = cameras.join(flag(mine.select("policy_id"), "by_policy"), "policy_id", "left").join(flag(where, "by_location"), "location_id", "left").filter(F.coalesce("by_policy", F.lit(False)) | F.coalesce("by_location", F.lit(False)))
    sets = lambda df, c, name: df.agg(F.sort_array(F.collect_set(c)).alias(name)).withColumn("one", F.lit(1))
    level = mine.agg(F.coalesce(F.max(level_rank("security_level")), F.lit(0)).alias("max_level")).withColumn("one", F.lit(1))
    return sets(mine, "policy_id", "policies").join(sets(where, "location_id", "locations"), "one").join(sets(reached, "camera_id", "cameras"), "one").join(level, "one").drop("one")
