"""Named queries of the driver contract and the SQL they are compared with."""
