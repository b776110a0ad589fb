"""Path of the small tables (a module name of its own: ``conftest`` exists twice)."""

SF = "/root/testdata/sf0.001"
