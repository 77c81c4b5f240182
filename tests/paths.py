"""Folders of the test data."""

SF = "/root/testdata/sf0.001"
