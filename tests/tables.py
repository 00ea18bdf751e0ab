"""The smallest data set."""

SF = "/root/testdata/sf0.001"
