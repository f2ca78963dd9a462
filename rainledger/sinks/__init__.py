from .shared import shared_folder, stored, working_tables
from .table import clean_filename, ordered, write_table

__all__ = ["clean_filename", "ordered", "shared_folder", "stored", "working_tables", "write_table"]
