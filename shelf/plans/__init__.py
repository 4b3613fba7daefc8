"""Plan tables: where files go, how they are renamed, how a run is undone."""
