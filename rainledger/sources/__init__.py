from .documents import (
    document_rejects, elevation_cells, flatten_timeseries, load_observations, load_report,
    read_documents, season_rejects, spatial_units,
)
from .tables import (
    check_seasons, check_years, is_utf8, parse_locations, read_csv_text, read_interventions,
    read_observations, select_observations,
)

__all__ = [
    "check_seasons", "check_years", "document_rejects", "elevation_cells", "flatten_timeseries", "is_utf8",
    "load_observations", "load_report", "season_rejects", "parse_locations", "read_csv_text", "read_documents", "read_interventions",
    "read_observations", "select_observations", "spatial_units",
]
