"""All detectors of a repository, and the summary of what they found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import app_detectors as A
from . import detectors as D

#: Detectors by name; a further one is a function from files to a DataFrame.
DETECTORS = {
    "framework": D.framework,
    "structure": A.structure,
    "routes": D.routes,
    "components": A.components,
    "services": D.services,
    "database": A.database,
    "packages": A.packages,
    "stores": A.stores,
    "trpc_routers": A.trpc_routers,
    "i18n": A.i18n,
    "auth": A.auth,
    "server_modules": A.server_modules,
    "llm_providers": A.llm_providers,
    "sso_providers": A.sso_providers,
    "env_vars": D.env_vars,
    "hooks": D.hooks,
    "scripts": D.scripts,
    "libs": D.libs,
}
#: Columns of the summary that count rows, and what they count.
COUNTS = {"routes_count": "routes", "components_count": "components", "services_count": "services", "stores_count": "stores", "trpc_routers_count": "trpc_routers", "server_modules_count": "server_modules", "ai_providers_count": "llm_providers", "sso_providers_count": "sso_providers", "hooks_count": "hooks", "scripts_count": "scripts", "env_vars_total": "env_vars", "libs_count": "libs"}
#: Mappers in the order in which the first counts as the repository's (fixed values).
ORMS = ("Prisma", "Drizzle", "TypeORM")


def scan_repository(files: DataFrame) -> dict[str, DataFrame]:
    """All detectors over the files of a repository, as independent plans."""
    return {name: detect(files) for name, detect in DETECTORS.items()}


def summarize(found: dict[str, DataFrame]) -> DataFrame:
    """One row of counts and headline facts, from detectors' results as scanned or as read back from a store.

    What is missing counts as empty: zero, ``unknown`` for framework and language, else null or no names."""
    session = next(iter(found.values())).sparkSession
    orm = F.coalesce(*[F.when(F.col("orm") == o, i) for i, o in enumerate(ORMS)])
    facts = {
        "framework": ("framework", F.max("framework"), "string", F.lit("unknown")),
        "language": ("framework", F.max("language"), "string", F.lit("unknown")),
        "database": ("database", F.min_by("orm", orm), "string", F.lit(None)),
        "trpc_procedures_count": ("trpc_routers", F.sum(F.size("procedures")), "bigint", F.lit(0)),
        "i18n_source_lang": ("i18n", F.max("source_lang"), "string", F.lit(None)),
        "i18n_namespace_count": ("i18n", F.max("namespace_count"), "bigint", F.lit(0)),
        "auth_providers": ("auth", F.to_json(F.max("providers")), "string", F.lit("[]")),
        "db_models_count": ("database", F.min_by(F.size(F.coalesce("db_models", F.array())), orm), "bigint", F.lit(0)),
    } | {k: (t, F.count("*"), "bigint", F.lit(0)) for k, t in COUNTS.items()}
    parts = [found[t].agg(F.lit(k).alias("key"), value.cast("string").alias("value")) for k, (t, value, _, _) in facts.items() if t in found]
    rows = reduce(DataFrame.unionAll, parts, session.createDataFrame([], "key string, value string"))
    row = rows.agg(*[F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))).cast(kind), default.cast(kind)).alias(k) for k, (_, _, kind, default) in facts.items()])
    return row.withColumn("auth_providers", F.from_json("auth_providers", "array<string>"))
