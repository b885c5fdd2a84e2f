"""Settings of the process."""

from dataclasses import dataclass

ENV_QUERY_BACKEND = "QUADSPARK_QUERY_BACKEND"
ENV_STRICT = "QUADSPARK_STRICT"


@dataclass
class Config:
    query_backend: str = "sparql"


config = Config()
