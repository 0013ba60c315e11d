"""Incremental processing: new strips arrive as files, only the tiles that they touch are made again."""
