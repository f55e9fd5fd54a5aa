"""Training-data operators: licence scan, language identification, archives,
decontamination, extraction, near duplicates, token files, neighbour search,
repeated-substring removal and packing. Nothing else in the library imports
this subpackage; ``queries.py`` registers one query per operator."""
