"""Reading source trees, version histories and the reports of other tools; writing snapshots."""
